"""DataFrame operators: sessions, groups, joins, windows, labels, encodings, models, rules, learners, text."""
