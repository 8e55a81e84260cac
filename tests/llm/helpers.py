import os

#: Schemas of the awkward cases: nulls, empty and long texts, ties, repeated rows and clashing names.
LONG = ("alpha beta gamma delta. " * 4000) + "omega"


def awkward(spark):
    """doc_id, text, lang, source and columns whose names clash with inner ones."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 1, 1),
        (2, "one two three four five six seven", "en", "b", 2, 2),
        (2, "one two three four five six seven", "en", "b", 2, 2),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 0, 0),
        (5, "   \n\t ", "de", None, 0, 0),
        (6, LONG, "en", "c", 9, 9),
        (7, "12345 !!! ???", None, "a", 0, 0),
        (None, "one two three four five six seven", "en", "a", 1, 1),
        (8, "a\nshared line\nb", "en", "a", 0, 0),
        (9, "shared line\nc\n\n", "en", "b", 0, 0),
        (10, "shared line", "en", "c", 0, 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, rep int")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
