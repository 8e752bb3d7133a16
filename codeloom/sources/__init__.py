"""Project files and their parsers as sources of rows."""
