"""Windows of time, pipelines of blocks, and the jobs made of them."""
