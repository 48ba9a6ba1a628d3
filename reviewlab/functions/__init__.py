"""Column expressions: text cleaning, masking, label sets, overlap scores, token ids."""
