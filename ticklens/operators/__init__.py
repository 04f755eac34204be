"""DataFrame operators: cleaning, joining and reducing quotes, releases and gaps."""
