"""Fixed values of the appliance-log data model.

These must equal the reference's values for equal codes and labels.
"""

# Category codes of the settings.
SPEED_CODES = {"auto": 0, "silence": 1, "low": 2, "mid": 3, "high": 4, "super": 5}
DIRECTION_CODES = {"auto": 0, "vdir": 1, "hdir": 2}
MODE_CODES = {"wind": 0, "cool": 1, "heat": 2, "auto": 3, "dehu": 4}
# Temperature code = degrees - 24; the kept range is 24..28 degrees.
TEMP_OFFSET = 24
TEMP_RANGE = (24, 28)
# A power-on event line has this state text; any other state is off.
POWER_ON = "poweron"
# A header line starts with 3 characters before the user name; the
# address starts with a 2-character country; provinces starting with these two
# characters have 3-character names, all others 2.
HEADER_PREFIX_LEN = 3
COUNTRY_LEN = 2
LONG_PROVINCE_PREFIXES = ("黑龙", "内蒙")
# The 13 feature columns in dataset order, and the targets.
FEATURE_COLS = ("temp1", "temp2", "temp3", "speed1", "speed2", "speed3", "direction1", "direction2",
                "direction3", "mode1", "mode2", "mode3", "weather")
TARGET_COLS = ("speed", "direction", "mode", "temp")
# Categorical features of the trees: direction and mode codes (3 and 5 values).
NOMINAL_FEATURES = {"direction1": 3, "direction2": 3, "direction3": 3, "mode1": 5, "mode2": 5, "mode3": 5}
