"""The alignment of two tokenizers against byte offsets of whole texts."""

import collections
import hashlib

import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, queries

A, B = queries.BYTES, queries.MODEL
ODD = [
    (1, None), (2, ""), (None, "two words"), (None, "two words"), (3, "a ▁b"), (4, "  two  spaces \n x　y z \x1c q <s> <|endoftext|> </s>"), (5, "x" * 5000 + " "),
    (6, "don't  stop 123 456,789 \t 🙂🙂 ß\x00n e"), (7, " "), (8, "\n"), (9, "a  b   c"), (10, "é ﬁ ① naïve\r\n x"), (10, "repeated id"), (11, "many words " * 3000),
]


def by_offsets(rows):
    """Token ids and groups of each text, from the byte offsets where tokens end."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_entries(a), alignment.piece_entries(b)
    for doc, text in rows:
        x = y = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not b"".join(a_bytes[t] for t in x) == b"".join(b_bytes[t] for t in y) == (" " + text).encode():
                x = y = []
        ends = []
        for ids, spelled in ((x, a_bytes), (y, b_bytes)):
            at, n = {}, 0
            for k, t in enumerate(ids):
                n += len(spelled[t])
                at[n] = k + 1
            ends.append(at)
        both = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        yield doc, x, y, both


def digests(rows):
    rows = list(by_offsets(rows))
    counts = collections.Counter((x[i - 1], y[j - 1]) for _, x, y, both in rows for i, j in both)
    most = collections.defaultdict(int)
    for (_, q), c in counts.items():
        most[q] = max(most[q], c)
    for doc, x, y, both in rows:
        pairs = [(x[i - 1], y[j - 1]) for i, j in both]
        cut = zip([(0, 0), *both], both, strict=False)
        text = ";".join(f"{','.join(map(str, x[i:ii]))}|{','.join(map(str, y[j:jj]))}" for (i, j), (ii, jj) in cut)
        yield doc, len(x), len(y), len(both), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, links int")


def test_digest_equals_byte_offsets(spark):
    assert ordered(alignment.digest(frame(spark, ODD), A, B).collect()) == ordered(digests(ODD))


def test_parts_do_not_change_results(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = ordered(digests(rows))
    assert ordered(queries.op11_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()) == want
    assert ordered(alignment.digest(docs.repartition(3), A, B, part_links=5000).collect()) == want


def test_groups_and_id_links(spark):
    got = alignment.align(frame(spark, ODD), A, B)
    want = [(d, x, y, [i for i, _ in both], [j for _, j in both]) for d, x, y, both in by_offsets(ODD)]
    assert ordered(got.collect()) == ordered(want)
    counts = collections.Counter((x[i - 1], y[j - 1]) for _, x, y, both in by_offsets(ODD) for i, j in both)
    best = {(p, q): c == max(v for (_, o), v in counts.items() if o == q) for (p, q), c in counts.items()}
    assert ordered(alignment.id_links(got).collect()) == ordered((p, q, c, best[p, q]) for (p, q), c in counts.items())


def test_empty_table(spark):
    none = frame(spark, ODD).limit(0)
    assert alignment.digest(none, A, B).collect() == [] and alignment.align(none, A, B).collect() == []


def test_forgetting_changes_nothing():
    texts = [t for _, t in ODD]
    few, many = alignment.Aligner(A, B, kept=1), alignment.Aligner(A, B)
    few.walks.most = 1
    for t in texts * 2:
        for one in (few, many):
            one.now = [(one.text[k], *one.sizes[k, :3]) for k in one.walk([t])[0]]
        assert few.now == many.now


def test_transducer_states():
    walks = alignment.Transducer([b"a", b"ab", b"abc", b"c"], [b"a", b"bc", b"abc", b"x"])
    assert walks.groups([1, 3], [0, 1]) == ([2], [2])
    assert walks.groups([0, 2], [0, 2]) == ([1, 2], [1, 2])
    assert walks.groups([1], [0]) is None and walks.groups([0], [0, 1]) is None and walks.groups([0], [3]) is None
    assert walks.groups([], []) == ([], [])
