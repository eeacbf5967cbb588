"""Header-line parsing: user name and province/city from an address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab.functions.codes import COUNTRY_LEN, HEADER_PREFIX_LEN, LONG_PROVINCE_PREFIXES


def header_user(first_field: str | Column, prefix_len: int = HEADER_PREFIX_LEN) -> Column:
    """User name: the first field without its fixed-length prefix."""
    c = F.col(first_field) if isinstance(first_field, str) else first_field
    return F.substring(c, prefix_len + 1, 1 << 30)


def parse_address(address: str | Column, long_prefixes: Sequence[str] = LONG_PROVINCE_PREFIXES,
                  country_len: int = COUNTRY_LEN, missing: str = "None") -> tuple[Column, Column]:
    """``(province, city)`` of ``<country><province><city>`` (character
    counts, not bytes). The province has 3 characters when it starts with one
    of ``long_prefixes``, else 2. The text ``missing`` gives NULLs."""
    a = F.col(address) if isinstance(address, str) else address
    head = F.substring(a, country_len + 1, 2)
    plen = F.when(head.isin(*long_prefixes), F.lit(3)).otherwise(F.lit(2))
    present = a.isNotNull() & (a != F.lit(missing))
    province = F.when(present, F.substring(a, F.lit(country_len + 1), plen))
    city = F.when(present, F.substring(a, plen + F.lit(country_len + 1), F.lit(1 << 30)))
    return province, city
