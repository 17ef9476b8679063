"""fragmill: molecule fragments and byte-pair tokens as Spark DataFrame operators."""
