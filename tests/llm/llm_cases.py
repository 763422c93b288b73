"""Texts that operators must bear."""

LONG = " ".join(f"word{i % 977}x" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today"), (3, None), (4, ""), (5, "   \n\t "),
    (6, "one two"), (7, "one two"), (7, "one two"), (8, "Ärger über Öl 🙂 naïve café"), (9, LONG), (10, LONG + " end"), (None, "a row without an id has words as well"), (11, "x" * 50_000), (12, "!!! ??? ..."),
    (13, "mail a.b@mail.example.com or +1 (456) 555-2186, card 4111 1111 1111 1111, ip 10.0.0.255"),
]
