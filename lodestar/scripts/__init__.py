"""Scripts of the Lua 5.1 grammar: syntax, code facts, findings and edits."""
