"""Column functions: everything stays in generated code unless a docstring says otherwise."""
