"""Column functions: amounts, dates, identifiers, names and memos. None of them runs Python on the data."""
