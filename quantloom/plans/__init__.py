"""The rule language, compiled to Columns, and the strategies built with it."""
