"""The library's streaming."""
