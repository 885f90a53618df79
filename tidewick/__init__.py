"""Order-book market analytics on Spark: candles, tickers, books, histories and health checks as DataFrame functions."""
