"""Transit timetable and map-feature analytics on Spark DataFrames."""
