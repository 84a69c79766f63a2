"""Query catalogue: column mappings onto operators, with their SQL counterparts."""
