"""Small tables with the cases every operator must take: nulls, empties, long texts, ties, repeats, clashing names."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = "score double, spans string, kept boolean, n_words int, th string, k_id int, fp long, node long, ids string, word string, training int, block int, component_id string, _row int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8))) for _ in range(n))


def edge_rows():
    base = words(1, 60)
    return [
        (0, base, "en", "s0", 1),
        (1, base, "en", "s1", 1),  # an exact copy
        (2, None, None, None, None),
        (3, "", "en", "s0", 0),
        (4, " \t\n\x0b\x0c\r ", "en", "s0", 7),
        (5, words(2, 20_000), "en", "s0", 1),
        (6, "Älter ßtraße ﬁn x y 😀 mail a.b@c-d.org now +1 (555) 123-4567 card 4111 1111 1111 1111 at 10.0.0.1", "de", "s2", 9),
        (7, "one two three", "en", "s0", 13),
        (8, "line A\nline A\nline A\n" + words(3, 40), "en", "s0", 5),
        (8, "line A\nline A\nline A\n" + words(3, 40), "en", "s0", 5),  # a repeated row
        (9, words(4, 12) + " " + " ".join([words(5, 9)] * 6), "en", "s0", 5),
        (None, "text of no id " + words(6, 30), "en", "s0", 5),
        (10, base.replace(base.split()[30], "changed", 1), "en", "s0", 1),
        (11, "<|endoftext|> it's  we'll\t\tgo   123abc...!? ", "en", "s3", 1),
    ]


def documents(spark, rows=None, clash=False):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOC_SCHEMA)
    if clash:
        for part in CLASHES.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def split_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def root_table(pairs, nodes):
    """Smallest node reachable, by union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}
