"""Record processing with COBOL semantics as DataFrame plans."""
