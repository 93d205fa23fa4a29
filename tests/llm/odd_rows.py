LONG = "word another third " * 20_000

#: nulls, empty and blank texts, a very long one, ties and repeated rows
NASTY = [
    (1, "One two three four five six seven eight."), (2, None), (3, ""), (4, " \t\n "), (5, "one TWO three four five six seven eight."),
    (5, "one TWO three four five six seven eight."), (None, "a text without an id and with words"), (None, None),
    (6, LONG), (7, "x"), (8, "ü ß é 漢字 😀 \x00 ok"), (2**62, "last"), (-3, "first of all"),
]
