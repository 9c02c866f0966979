"""Sources: file trees, JSON submissions, ticker maps, HTTP and prompts."""
