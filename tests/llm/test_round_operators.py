"""Suffix dedup, Merkle manifest and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from check_oracles import compare, connect
from graphrecon.llm import conversations, merkle, suffix_dedup
from graphrecon.llm.queries import ORACLES, QUERIES


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# --- suffix dedup -----------------------------------------------------------------------------


def cut_by_hand(texts, length=suffix_dedup.LENGTH):
    """(bytes, removed, runs, kept) of each text."""
    data = [(x or "").encode() for x in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered, last = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                begin = max(i, last)
                last = i + length
                covered[begin:last] = b"\1" * (last - begin)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(b), sum(covered), runs, kept))
    return out


def noise(rng, size):
    return "".join(rng.choice("abcdefgh ijklm\nnopä漢é") for _ in range(size))


def awkward_texts():
    rng = random.Random(5)
    passage, other = noise(rng, 420), noise(rng, 900)
    edits = [other[:at] + "#" + other[at + 1 :] for at in range(0, 900, 37)]
    exact = noise(rng, 400)
    return [
        None,
        "",
        "short",
        "short",
        noise(rng, 3000),
        noise(rng, 200) + passage + noise(rng, 300),
        passage,
        noise(rng, 5) + passage,
        other,
        other,
        *edits,
        exact,
        "x" + exact,
        exact[:-1] + "!",
        "ab" * 600,
        "b" + "ab" * 300,
        "z" * 399,
        "y" * 400,
        "w" * 401,
        noise(rng, 30) + "w" * 450,
        (passage + noise(rng, 20)) * 3,
    ]


@pytest.mark.parametrize("part", [1 << 20, 600])
def test_repeats_equal_brute_force(documents, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    texts = awkward_texts()
    want = cut_by_hand(texts)
    rows = suffix_dedup.remove_repeats(documents(*texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, i


def test_repeats_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: (n, gone, runs, sha(kept)) for d, (n, gone, runs, kept) in zip(docs, cut_by_hand([d["text"] for d in docs]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_suffix_dedup"](spark, sf).collect()}
    assert got == want and any(r[1] for r in want.values())


def test_repeats_odd_rows(spark, odd_documents):
    rows = suffix_dedup.remove_repeats(odd_documents).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    # "word " over and over: all its strings stand elsewhere too, and nothing is left.
    assert by[4]["n_removed"] == by[4]["n_bytes"] == 150_000 and bytes(by[4]["kept"]) == b""
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 4)
    assert (by[1]["n_bytes"], bytes(by[1]["kept"])) == (0, b"")
    assert suffix_dedup.remove_repeats(odd_documents.where("false")).count() == 0
    renamed = odd_documents.selectExpr("doc_id AS text_id", "text AS spans", "spans AS key", "lang AS n_bytes")
    assert suffix_dedup.remove_repeats(renamed, "text_id", "spans").count() == 10


# --- Merkle manifest --------------------------------------------------------------------------


def level_up(nodes):
    return [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def tree_by_hand(nodes):
    """Root, and for each leaf its siblings as (is left, digest), empty where alone."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            beside = at ^ 1
            paths[leaf].append((at % 2 == 1, nodes[beside] if beside < len(nodes) else ""))
        nodes, places = level_up(nodes), [p // 2 for p in places]
    return nodes[0], paths


def manifest_by_hand(rows):
    """{row: (leaf, subroot, root, proof)} for rows of (doc_id, source, lang, n_chars, text)."""
    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    leaves = {i: sha("".join(map(value, r))) for i, r in enumerate(rows)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[2], []).append(i)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = {}, []
    for g in ordered:
        members = sorted(groups[g], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        subroot, paths = tree_by_hand([leaves[i] for i in members])
        subroots.append(subroot)
        found |= {i: (subroot, path) for i, path in zip(members, paths)}
    root, above = tree_by_hand(subroots)
    at = {g: path for g, path in zip(ordered, above)}
    return {i: (leaves[i], subroot, root, path + at[rows[i][2]]) for i, (subroot, path) in found.items()}


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    sizes = {"en": 23, None: 1, "de": 8, "": 9, "zü": 2, "a.b": 5}
    rows = [(i * 3 % 101, None if i % 5 == 0 else "s", g, None if i % 4 == 0 else i, f"text é {i}" if i % 3 else None) for g, n in sizes.items() for i in range(n)]
    rows += [rows[0], (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.document_manifest(frame, merkle.F.lit(False)).collect()
    want = manifest_by_hand(rows)
    plain = sorted((w[0], w[1], w[2], w[3]) for w in want.values())
    assert sorted((r["leaf"], r["subroot"], r["root"], [(s["left"], s["digest"]) for s in r["siblings"]]) for r in got) == plain


def test_manifest_query(spark, sf):
    got = QUERIES["op12_merkle_manifest"](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(ORACLES["op12_merkle_manifest"]).df()) == ""
    changed = got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 7 == 0)
    assert changed.any() and (got["verified"] == ~changed).all()


def test_manifest_odd_rows(odd_documents):
    rows = merkle.document_manifest(odd_documents, merkle.F.lit(True)).collect()
    assert len(rows) == 10 and len({r["root"] for r in rows}) == 1 and len({r["subroot"] for r in rows}) == 4
    assert sum(r["altered"] is None for r in rows) == 1  # the null count
    assert merkle.document_manifest(odd_documents.where("false"), merkle.F.lit(True)).count() == 0


# --- conversation repair ----------------------------------------------------------------------


def repaired_by_hand(rows):
    """Least (cost, audit, repaired rows) over a full table; ``rows``: (role, text, fault)."""
    states = {"": (0, "", [])}

    def with_inserts(now):
        for _ in range(3):
            for s, (cost, audit, out) in list(now.items()):
                role = "assistant" if s == "u" else "user"
                new = (cost + 5, audit + "I", [*out, (role, "")])
                if role[0] not in now or new < now[role[0]]:
                    now[role[0]] = new
        return now

    for role, text, fault in rows:
        after = {}

        def offer(s, new):
            if s not in after or new < after[s]:
                after[s] = new

        for s, (cost, audit, out) in with_inserts(dict(states)).items():
            offer(s, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[s]
            if role[:1] and role[:1] in fits:
                offer(role[0], (cost + more, audit + "K", [*out, (role, text)]))
            for new in ("user", "assistant"):
                if new[0] in fits:
                    offer(new[0], (cost + more + 1, audit + "R", [*out, (new, text)]))
        states = after
    ends = with_inserts(dict(states))
    return min(ends[s] for s in ("", "a") if s in ends)


SPACE = " \t\n\x0b\x0c\r"


def conversation_by_hand(rows):
    """Digest columns for one conversation's given rows (turn, role, text), its id being ``conv``."""
    def run(conv, given):
        kept = []
        for turn, role, text in given:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fate = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in kept:
            ends = text.rstrip(SPACE)
            fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, out = repaired_by_hand(judged)
        return (gaps, *faults, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))

    return {conv: run(conv, given) for conv, given in rows.items()}


def random_conversations(seed, count, longest):
    rng, found = random.Random(seed), {}
    texts = ["Yes.", "No!", "Why?", "cut short", "", " \n", "Well. ", None, "é.", "Yes.\x0b"]
    for conv in [None, *range(count)]:
        size = rng.choice([1, 2, 5, longest])
        turns = [rng.choice([None, -1, t, t, t + 3]) for t in range(size)]
        found[conv] = [(t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for t in turns]
    return found


@pytest.mark.parametrize("block, fan", [(1024, 256), (3, 2)])
def test_repair_equals_brute_force(spark, block, fan, monkeypatch):
    monkeypatch.setattr(conversations, "FAN", fan)
    given = random_conversations(block, 60, 40)
    rows = [(conv, *r, "x") for conv, some in given.items() for r in some]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(frame, block).collect()}
    want = conversation_by_hand(given)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], (conv, given[conv])


def test_crossings_equal_the_full_table():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "t", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 14))]
        codes = "".join(conversations.code(r[0][0], r[2][:1] or "-") for r in rows)
        audit = conversations.audit_of(codes)
        cost, want, _ = repaired_by_hand(rows)
        assert audit == want and conversations.counts_of(codes, audit)[4] == cost


def test_repaired_rows(spark):
    given = [(1, 5, "user", "One?"), (1, 6, "tool", "Two."), (1, 7, "user", "Three?"), (1, 8, "assistant", " ")]
    rows = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    plain = rows.selectExpr("concat('=', conv_id) AS conv", "turn", "role", "text")
    edits = conversations.block_edits(conversations.row_codes(plain), 2)
    out = conversations.repaired_rows(plain, edits).orderBy("at").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in out] == [("user", "One?", "K"), ("assistant", "Three?", "R")]


def test_repair_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string, audit string"
    rows = [("a", 1, "user", "word " * 30_000 + ".", "x"), ("a", 2, "assistant", "Yes.", None), (None, None, None, None, None)]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows * 2, schema)).collect()}
    assert set(got) == {"a", None} and got[None]["blank"] in (0, 2)
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0


def test_repair_query(spark, sf):
    got = QUERIES["op13_conversation_repair"](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(ORACLES["op13_conversation_repair"]).df()) == ""
    assert got["cost"].sum() > 0
