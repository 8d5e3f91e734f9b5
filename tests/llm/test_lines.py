"""Line dedup, licences and secrets."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import licenses, line_dedup, secrets, words
from pairwright.llm.queries import QUERIES


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_edit_distance():
    draw = random.Random(6)
    for _ in range(500):
        a, b = ("".join(draw.choice("abc ") for _ in range(draw.randint(0, 20))) for _ in "ab")
        assert line_dedup.edit_distance(a, b) == levenshtein(a, b)


def direct_removed(docs, similarity=0.8):
    """``docs``: (doc_id, text), ids unique. Line numbers to remove, by id, from all pairs of lines."""
    places: dict[str, list] = {}
    for i, text in docs:
        for n, line in enumerate(text.split("\n") if text is not None else ()):
            if key := line_dedup.normalised(line):
                places.setdefault(key, []).append((i, n))
    lines = sorted(places, key=lambda x: (len(x), x))
    # an edit changes the counts of at most two characters, each by one
    counts = np.zeros((len(lines), 64), np.int16)
    for i, x in enumerate(lines):
        np.add.at(counts[i], [ord(c) % 64 for c in x], 1)
    sizes = np.array([len(x) for x in lines])
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        room = (1 - similarity) * sizes[i + 1 :] + 1e-9
        for j in np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= 2 * room) + i + 1:
            if line_dedup.edit_distance(lines[i], lines[j]) <= (1 - similarity) * sizes[j] + 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups: dict[int, list] = {}
    for i, line in enumerate(lines):
        groups.setdefault(find(i), []).extend(places[line])
    removed: dict = {}
    for group in groups.values():
        for i, n in set(group) - {min(group)}:
            removed.setdefault(i, []).append(n)
    return {i: sorted(n) for i, n in removed.items()}


def test_line_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op5_fuzzy_line_dedup"](spark, small).collect()
    assert {r.doc_id: r.n_lines for r in got} == {i: len(t.split("\n")) for i, t in docs}
    assert {r.doc_id: r.removed for r in got if r.removed} == direct_removed(docs)
    assert all(r.n_removed == len(r.removed) for r in got)


def removed_lines(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_dedup.with_removed(frame, [frame.doc_id]).collect()
    return {r.row.doc_id: sorted(r.removed) for r in found if r.removed}


@pytest.mark.parametrize("length", [9, 120])
def test_crowds_of_near_lines(spark, monkeypatch, length):
    """Blocks that many lines share, in small chunks, and families in small chunks."""
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", 7)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 6)
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 50)
    monkeypatch.setattr(line_dedup, "BUCKET_KEYS", 100)
    draw = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    base = [draw.choice(words) for _ in range(length)]
    docs = []
    for i in range(40):
        line = list(base)
        for _ in range(1 + length // 40):
            line[draw.randrange(length)] = draw.choice(words)
        docs.append((i, " ".join(line) + f"\nown line {draw.choice(words)} {i}\n\n!!!"))
    got = removed_lines(spark, docs)
    assert got == direct_removed(docs)
    assert sum(len(n) for n in got.values()) > 20


def test_a_link_to_a_line_in_a_crowd_is_kept(spark):
    """B is near A, C is like B only; A and C are too far apart."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)]
    a = words[:30]
    b = [*a[:27], *words[30:33]]
    c = [*words[40:44], *b[4:]]
    docs = [(i, " ".join(x)) for i, x in enumerate((a, b, c))]
    got = removed_lines(spark, docs)
    assert got == direct_removed(docs) == {1: [0], 2: [0]}
    alone = [docs[0], docs[2]]
    assert removed_lines(spark, alone) == direct_removed(alone) == {}


def edited(draw, line, kind, share, words):
    parts = list(line) if kind == "characters" else line.split(" ")
    places = [i for i, c in enumerate(parts) if c != " "]
    for i in draw.sample(places, max(1, int(share * len(places)))):
        parts[i] = draw.choice("qxzjk") if kind == "characters" else draw.choice(words)
    return ("" if kind == "characters" else " ").join(parts)


@pytest.mark.parametrize("least,most", [(1, 4), (5, 8), (9, 14), (15, 25), (26, 50), (51, 100), (101, 10**6)])
@pytest.mark.parametrize("kind,share", [("characters", 0.02), ("characters", 0.05), ("words", 0.1), ("words", 0.15)])
def test_edited_copies_share_blocks(small_lines, least, most, kind, share):
    """Of edited copies that stay similar, at least nine in ten are candidates, at every length."""
    draw = random.Random(f"{least}{kind}{share}")
    words = sorted({w for x in small_lines for w in x.split(" ")})
    lines = [x for x in small_lines if least <= len(x.split(" ")) <= most and len(x) >= 10]
    found = total = 0
    for line in (draw.choice(lines) for _ in range(60)):
        other = edited(draw, line, kind, share, words)
        if other != line and line_dedup.alike(line, other, 0.8):
            total += 1
            found += candidates(line, other)
    assert total == 0 or found >= 0.9 * total


def candidates(*lines):
    columns = [c.to_pylist() for c in line_dedup.sketch_columns([x.encode() for x in lines])]
    short_radius = line_dedup.short_radius(np.array([max(map(len, lines))]))[0]
    for prints, packed, radius in ((columns[1:3], columns[3], line_dedup.RADIUS), (columns[4:6], columns[6], short_radius)):
        if None not in packed:
            a, b = (set(line_dedup.keys_from_bytes(k).tolist()) for k in packed)
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in prints)
            if a & b and apart <= radius:
                return True
    return False


@pytest.fixture(scope="module")
def small_lines(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    return sorted({line_dedup.normalised(x) for t in texts for x in t.split("\n")} - {""})


def test_deduplicated_edge_rows(spark, edge_docs, no_docs):
    out = line_dedup.deduplicated(edge_docs)
    assert out.columns == edge_docs.columns
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == edge_docs.count()
    assert (0, None) in rows and (1, "") in rows and (3, "123 !!! 456") in rows
    assert (5, "") in rows  # both its lines are those of 4
    assert all(r.n_chars == len(t) for (_, t), r in rows.items() if t is not None)
    assert line_dedup.deduplicated(no_docs).count() == 0


# --- licences


def test_license_lines_are_found_and_nothing_else(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lines = ("all_rights_reserved", "apache_2_line", "cc_by_nc_line", "gpl_3_line", "mit_line")
    for r in QUERIES["op3_license_scan"](spark, small).collect():
        want = {n for n in lines if licenses.TEMPLATES[n].lower().rstrip(".") in docs[r.doc_id].lower()}
        assert set(r.templates.split(",")) - {""} == want
        for name, start, end in (s.split(":") for s in r.spans.split(",") if s):
            found = docs[r.doc_id][int(start) : int(end)].lower()
            assert found == licenses.TEMPLATES[name].lower().rstrip(".")


def direct_share(words, template, width):
    own = {tuple(template[i : i + width]) for i in range(len(template) - width + 1)}
    reach = len(template) + len(template) // 2
    best = 0.0
    for start in range(len(words)):
        near = words[start : start + reach]
        best = max(best, len({tuple(near[i : i + width]) for i in range(len(near))} & own) / len(own))
    return best


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_edited_templates(name):
    index = licenses.build_index()
    draw = random.Random(name)
    template = licenses.word_list(licenses.TEMPLATES[name])
    for edits in range(4):
        words = list(template)
        for _ in range(edits):
            words[draw.randrange(len(words))] = "zzz"
        text = "some text " * draw.randint(0, 9) + " ".join(words) + " and more" * 40
        share = direct_share(licenses.word_list(text), template, min(5, len(template)))
        found = {m[0]: m for m in licenses.scan(index, [text])[0]}
        assert (name in found) == (share >= licenses.CONTAINMENT), (edits, share)


def test_license_edge_rows(spark, edge_docs, no_docs):
    got = licenses.license_matches(edge_docs).collect()
    assert len(got) == edge_docs.count() and not any(r.matches for r in got)
    assert licenses.license_matches(no_docs).count() == 0
    twice = licenses.TEMPLATES["gpl_3_notice"] + " x" * 60 + licenses.TEMPLATES["gpl_3_notice"].upper()
    found = licenses.scan(licenses.build_index(), ["İ " + twice])[0]
    assert [m[0] for m in found] == ["gpl_3_notice"] * 2
    assert ("İ " + twice)[found[0][1] : found[0][2]] == licenses.TEMPLATES["gpl_3_notice"][:-1]


# --- secrets

SECRET = 'api_key = "Zx81hunter2hunter2"'
ASSIGNED = 'api_key = "Zx81hunter2hunter2'


def direct_base(text):
    found = [
        (m.start(), 0, m.end())
        for m in re.finditer(
            r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            text,
            re.ASCII,
        )
        if len(m[2]) >= 6
    ]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_query_equals_direct_scan(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    kinds = ("assign", "access", "hex")
    for r in QUERIES["op10_secret_scan"](spark, small).collect():
        base = direct_base(docs[r.doc_id])
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(written.split(",")) <= set(r.spans.split(","))


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize(
    "wrapped",
    [
        b64(SECRET),
        b64(b64(SECRET)),
        base64.urlsafe_b64encode(b"\xc3\xbf\xc3\xbe" + SECRET.encode()).decode(),
        b64(gzip.compress(SECRET.encode())),
        b64(gzip.compress(b64(SECRET).encode())),
        urllib.parse.quote(SECRET, safe=""),
        urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        urllib.parse.quote(b64(SECRET) + "==", safe=""),
        "".join(f"%{ord(c):02x}" for c in b64(SECRET)),
    ],
)
def test_wrapped_secrets_map_to_their_span(wrapped):
    text = "héé voilà " + wrapped + " tail"
    base, spans = secrets.find(text)
    inside = [s for s in spans if s[1] == 0]
    assert inside and set(base) <= set(spans)
    for start, _, end in inside:
        assert 10 <= start < end <= 10 + len(wrapped)


def test_percent_span_is_exact():
    text = "é " + urllib.parse.quote(SECRET) + " x"
    _, spans = secrets.find(text)
    start, _, end = next(s for s in spans if s[1] == 0)
    assert urllib.parse.unquote(text[start:end]) == ASSIGNED


def test_layers_end():
    loop = "%25" * 2000 + "41"
    assert secrets.find(loop) == ([], [])
    bomb = b64(gzip.compress(b"a" * 5000))
    run = (0, secrets.KINDS.index("hex"), len(bomb.rstrip("=")))
    assert secrets.find(bomb, most_bytes=100) == ([], [run])  # what comes within the bound counts
    assert secrets.find(bomb, most_bytes=20) == ([], [])


def test_equal_wrapped_secrets_have_a_span_each():
    one = b64(gzip.compress(b64(SECRET).encode()))
    for wrapped in (b64(SECRET), one):
        text = f"Cookie: {wrapped}\n;; Cookie: {wrapped}; {b64('x ' + wrapped)}"
        places = [m.start() for m in re.finditer(re.escape(wrapped), text)]
        spans = [s for s in secrets.find(text)[1] if s[1] == 0]
        for place in places:
            assert any(place <= a < b <= place + len(wrapped) for a, _, b in spans)
        assert any(a > places[-1] + len(wrapped) for a, _, b in spans)


def lines_of(text, width):
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


LONG = "noise " * 30 + SECRET + " tail" * 20


@pytest.mark.parametrize(
    "wrapped",
    [
        b64(gzip.compress(gzip.compress(SECRET.encode()))),
        b64(zlib.compress(gzip.compress(zlib.compress(SECRET.encode())))),
        b64(gzip.compress(b"first") + gzip.compress(SECRET.encode())),
        lines_of(b64(gzip.compress(bytes(range(200)) + SECRET.encode())), 64),
        lines_of(b64(zlib.compress(bytes(range(200)) + SECRET.encode())), 76),
        lines_of(b64(LONG), 64).replace("\n", "\r\n  "),
        lines_of(b64(LONG[:170] + SECRET), 76).replace("\n", "\\n"),
        *[b64(mark + SECRET) for mark in ("\xa0", "\ufeff", "\u200b", "\x1b[0m ")],
        b64(b"\xff\xfe\x80 " + SECRET.encode()),
        b64(SECRET.encode("utf-16")),
        b64(SECRET.encode("utf-16-be")),
        *[prefix + b64(SECRET) for prefix in ("v1/", "key-", "a_", "ab/", "id")],
        *[prefix + b64(data(SECRET.encode())) for prefix in ("v1/", "key-", "a_") for data in (gzip.compress, zlib.compress)],
        urllib.parse.quote(gzip.compress(SECRET.encode())),
        urllib.parse.quote_plus(zlib.compress(b"  " + SECRET.encode() * 3)),
        b64("\xa0" + urllib.parse.quote(gzip.compress(gzip.compress(SECRET.encode())))),
    ],
)
def test_layers_are_unwrapped_to_the_end(wrapped):
    text = "h\xe9\xe9 voil\xe0 " + wrapped + " tail"
    spans = [s for s in secrets.find(text)[1] if s[1] == 0]
    assert spans
    assert all(10 <= start < end <= 10 + len(wrapped) for start, _, end in spans)


def test_secret_edge_rows(spark, edge_docs, no_docs):
    got = secrets.secret_spans(edge_docs).collect()
    assert len(got) == edge_docs.count() and not any(r.spans for r in got)
    assert secrets.secret_spans(no_docs).count() == 0


def test_lines_of_unlike_lengths_are_no_candidates(spark):
    """A line and the same line twice have the n-grams and blocks in common, but cannot be similar."""
    draw = random.Random(6)
    line = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40))
    docs = spark.createDataFrame([(0, line), (1, f"{line} {line}"), (2, f"{line} end")], "doc_id long, text string")
    keyed = docs.select(*line_dedup._row_key("doc_id", "text"), "text")
    lines = keyed.mapInArrow(line_dedup._line_batches, line_dedup.LINES).localCheckpoint()
    name = {r._doc: r.print for r in lines.collect()}
    links = line_dedup.block_links(lines, 0.8)[0].collect()
    assert [{r.a, r.b} for r in links] == [{name[0], name[2]}]
    assert removed_lines(spark, [(r.doc_id, r.text) for r in docs.collect()]) == {2: [0]}


def test_many_pairs_are_compared_as_one_by_one():
    draw = random.Random(7)
    pairs = []
    for i in range(700):
        line = "".join(draw.choice("abcdefg \u00e9\u6f22\U0001f600") for _ in range(draw.choice([1, 63, 64, 65, 128, 300])))
        other = list(line)
        for _ in range(draw.randrange(2 + len(line) // 3)):
            other[draw.randrange(len(other))] = draw.choice(["x", "", "yz"])
        pairs.append((line, "".join(other) if i % 50 else ""))
    got = line_dedup.alike_pairs(pairs, 0.8)
    assert got == [line_dedup.alike(a, b, 0.8) for a, b in pairs]
    assert {bool(x) for x in got} == {False, True}
    assert got == [line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]


def test_unlike_texts_are_told_apart_by_their_first_letters(monkeypatch):
    """Whole distances are for the few pairs whose beginnings could be alike; none is lost by that."""
    draw = random.Random(9)
    pairs = []
    for i in range(400):
        a = "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(200, 700)))
        b = "".join(draw.choice("abcdefgh ") for _ in range(len(a) - draw.randint(0, 20)))
        if i % 20 == 0:  # the end differs, in too much or not
            b = a[: len(a) * draw.choice([7, 9]) // 10] + b[: len(a) // 10]
        if i % 20 == 1:  # moved by letters in front
            b = "xyz" * (len(a) // 30) + a
        pairs.append((a, b))
    whole = []
    plain = line_dedup._edit_distances

    def counted(points, a, b, widths, prefix):
        whole.append(0 if prefix else len(a))
        return plain(points, a, b, widths, prefix)

    monkeypatch.setattr(line_dedup, "_edit_distances", counted)
    got = line_dedup.alike_pairs(pairs, 0.8)
    assert got == [line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert 20 <= sum(got) <= 40 and sum(whole) <= 40
    # a table of letters that is too large leaves pairs to the plain way
    monkeypatch.setattr(line_dedup, "TABLE_CELLS", 10)
    assert line_dedup.alike_pairs(pairs[:60], 0.8) == got[:60]


def test_a_sketch_does_not_depend_on_the_lines_around():
    draw = random.Random(10)
    lines = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n)).encode() for n in range(90, 190)]
    together = [c.to_pylist() for c in line_dedup.sketch_columns(lines)]
    alone = [[c[0].as_py() for c in line_dedup.sketch_columns([x])] for x in lines]
    assert alone == [list(x) for x in zip(*together, strict=True)]


def _edited(draw, line, edits):
    for _ in range(edits):
        i = draw.randrange(len(line))
        line = line[:i] + draw.choice(["", "x", "yz w", line[i] + line[i]]) + line[i + draw.randrange(3) :]
    return line


def _word_line(draw, words):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(words))


def test_a_quick_way_to_edit_costs_no_less_than_the_best():
    draw = random.Random(12)
    found = 0
    for i in range(600):
        a = _word_line(draw, draw.randint(1, 60))
        b = _edited(draw, a, draw.randint(0, 20)) if i % 3 else _word_line(draw, 30)
        distance = line_dedup.edit_distance(a, b)
        room = 0.2 * max(len(a), len(b))
        quick = line_dedup.edits_at_most(a, b, room)
        assert not quick or distance <= room
        found += quick
        assert not line_dedup.edits_at_most(a, b, distance - 1)
        assert (line_dedup.edit_distance(a, b, room) <= room) == (distance <= room)
    assert found > 200


def test_near_copies_need_no_whole_distances(monkeypatch):
    """They took most of the time of the line stage, one by one where a family is small."""
    draw = random.Random(13)
    lines = [_word_line(draw, 60) for _ in range(20)]
    pairs = [(x, _edited(draw, x, 6)) for x in lines]
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    monkeypatch.setattr(line_dedup, "_edit_distances", None)
    assert all(line_dedup.alike_pairs(pairs, 0.8))


def test_short_lines_of_a_block_are_compared_together(monkeypatch):
    draw = random.Random(14)
    texts = [_word_line(draw, 8)[:30] for _ in range(60)]
    texts = sorted({*texts, *(_edited(draw, x, 2) for x in texts[:20])})
    n = len(texts)
    want = {(i, j) for i in range(n) for j in range(i) if line_dedup.alike(texts[i], texts[j], 0.8)}
    one_by_one = []
    plain = line_dedup.edit_distance
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *a: one_by_one.append(a) or plain(*a))
    got = line_dedup.text_links(np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.array(texts, object), 0.8)
    group = {i: i for i in range(n)}
    for i, j in got:
        assert (max(i, j), min(i, j)) in want
        group = {x: group[i] if g == group[j] else g for x, g in group.items()}
    assert all(group[i] == group[j] for i, j in want)
    assert len(got) == n - len(set(group.values())) and len(one_by_one) < n


def test_small_families_are_verified_together(monkeypatch):
    """One call for many families; lines of two families never meet, nor those of one chunk of two."""
    draw = random.Random(15)
    columns = ["key", "chunk", "low", "high", "keys", "line", "content"]
    line = _word_line(draw, 30)
    rows = []
    for key in range(50):
        other = _word_line(draw, 30)
        for chunk, text in ((0, other), (key % 2, other + "x"), (key % 2, line), (0, line + "y")):
            rows.append((key, chunk, 0, 0, line_dedup.keys_to_bytes(np.array([7, 7, 9], np.uint64)), len(rows), text))
    calls = []
    plain = line_dedup.alike_rows
    monkeypatch.setattr(line_dedup, "alike_rows", lambda *a: calls.append(a) or plain(*a))
    table = pa.table(dict(zip(columns, map(list, zip(*rows)))))
    batches = line_dedup._verify_batches(0.8)(iter(table.to_batches(7)))
    got = {frozenset(p) for b in batches for p in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {frozenset((4 * k + i, 4 * k + i + 1)) for k in range(50) for i in (0, 2)}
    assert len(calls) == 1


def test_a_stage_gives_its_memory_back(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(1)

    monkeypatch.setattr(words.pa, "default_memory_pool", Pool)
    out = words.trimmed(lambda batches: (x + 1 for x in batches))(iter([1, 2]))
    assert next(out) == 2 and not given
    assert list(out) == [3] and given
