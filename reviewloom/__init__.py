"""Review analytics on Spark: DataFrame operators for mining, preparing, modelling and ranking reviews."""
