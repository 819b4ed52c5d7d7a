"""Column expressions: calendar, stock rules, alert rules, rounding."""
