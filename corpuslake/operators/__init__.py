"""Jobs over whole tables; every function takes and returns DataFrames."""
