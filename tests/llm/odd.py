"""Rows that operators must not stumble over."""

LONG = " ".join(f"w{i % 997} x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, " \n\t "), (None, "a b c d e f g h i j k l"), (5, LONG), (6, "Ünï códe x \U0001F600 ▁ y"), (7, "\n\n")]
