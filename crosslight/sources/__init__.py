"""Reading vendor payloads and writing results."""
