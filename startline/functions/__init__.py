"""Column-to-column functions, built-ins only except where a module says otherwise."""
