"""Column functions: text normalisation, tokens, identifiers, replies, recognised text."""
