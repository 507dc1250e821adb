"""Operations on training text and vectors. Nothing outside imports this package."""
