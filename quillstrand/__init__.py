"""quillstrand: sequencing-read and numeric-array compression dataflows on Spark."""
