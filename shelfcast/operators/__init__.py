"""DataFrame operators (each ``f(df, ...) -> DataFrame``)."""
