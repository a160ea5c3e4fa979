"""Reading, shaping and writing tables of price bars."""
