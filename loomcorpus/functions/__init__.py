"""Column functions: hashing, text, denoising, dates, metadata prefixes, weights."""
