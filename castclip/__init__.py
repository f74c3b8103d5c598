"""castclip: Spark jobs for clip selection over large collections of recorded talk."""
