"""Table storage, and readers and writers of other formats."""
