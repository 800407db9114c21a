"""SQL functions under the names and meanings of other dialects."""
