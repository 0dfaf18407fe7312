"""Panel analytics on Spark: dense entity x period panels, factor expressions compiled to columns and windows, their scores, selection and backtests."""
