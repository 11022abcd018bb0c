"""Documents with every odd case, and brute-force versions of operators."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside; documents may have their own of these names.
CLASHING = ["label", "score", "fp", "component_id", "item_id", "position", "block", "start", "n_tokens", "key", "n", "th", "part", "slot", "at", "kind", "id", "gone", "copies", "rank"]
LONG = "long text with many words " * 20_000


def odd_rows():
    same = "the same words come again and again in both of these rows, which is a copy " * 3
    return [
        (1, None, None, None, None),
        (2, "", "en", "web", 0),
        (3, " \t\n ", "en", "web", 4),
        (4, same, "en", "web", len(same)),
        (4, same, "en", "web", len(same)),
        (5, same, "de", None, len(same)),
        (5, "another text under the same id", "de", "web", 30),
        (None, "a row without an id", None, "web", 19),
        (6, LONG, "en", "hot", len(LONG)),
        (2**53 + 1, "ünïcödé 漢字 😀 \x00 x", "xx", "hot", 1),
    ]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    for c in CLASHING:
        df = df.selectExpr("*", f"'own' AS {c}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def pairs(spark, name, *cols):
    return [tuple(r) for r in table(spark, name).select(*cols).collect()]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(prints, max_bits=2):
    """Least doc_id of each fingerprint's class; prints: (doc_id, fingerprint)."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {f: least.get(find(f)) for f in values}


def contained(text, item, size=5, threshold=0.8):
    """Distinct shingles of the item that the text has, and how many the item has, if these are enough; else None."""
    words, of = re.findall(r"\w+", (text or "").lower()), re.findall(r"\w+", (item or "").lower())
    if len(of) < size:  # only as all that the text says
        return (1, 1) if of and words == of else None
    need = {tuple(of[i : i + size]) for i in range(len(of) - size + 1)}
    have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return (len(need & have), len(need)) if len(need & have) >= threshold * len(need) - 1e-9 else None


def repeated_bytes(rows, length=100):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256); rows: distinct (doc_id, text) in order."""
    seen, out = set(), {}
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    words, lines = find(text), [x for x in text.split("\n") if find(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3
