"""Where signals come from: Parquet, text formats, simulators and the star-schema fixtures."""
