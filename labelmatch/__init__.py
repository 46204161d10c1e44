"""labelmatch: product matching and catalog analytics as functions from DataFrame to DataFrame."""
