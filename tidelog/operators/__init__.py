"""What is done with lines and entries: folding, merging, counting, paging, explaining."""
