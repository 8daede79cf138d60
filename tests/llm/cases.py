"""Rows that operators must cope with."""

#: Nulls, empty and odd texts, ties, repeated rows, characters beyond Latin-1, special strings.
ODD = [
    (1, "Hello  world, this is\ta test.", "en", "a", 1),
    (2, "Hello world, this is a test.", "en", "a", 1),
    (2, "Hello world, this is a test.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "de", "b", 3),
    (6, "x<|endoftext|>y <|endoftext|>", "en", None, 5),
    (7, "日本語のテキスト 😀 naïve ﬁ ½ ²³ ՘    z", None, "c", 9),
    (8, "It's 12345 o'clock -- don't\r\n\r\n  stop!!", "en", "c", 9),
    (None, "Hello world, this is a test.", "en", "c", 9),
    (9, "ab " * 30_000, "en", "d", 90_000),
    (10, "=" * 70_000, "en", "d", 70_000),
    (11, "Ünïcode straße ÀÉ", "de", "d", 17),
]
