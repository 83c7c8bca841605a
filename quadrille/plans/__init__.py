"""From query text to DataFrame plans: lexer, parser, compiler."""
