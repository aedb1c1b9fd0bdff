"""Reading and writing flow tables, requests, responses and models."""
