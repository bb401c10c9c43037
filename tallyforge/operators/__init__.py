"""DataFrame operators: windows, joins, reshaping, apportionment, ranked choice."""
