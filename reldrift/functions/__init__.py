"""Column expressions: path rules, comment removal, URL rules, entropy, labels."""
