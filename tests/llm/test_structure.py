"""op11 to op13 against brute force: tokenizer alignment, conversation repair and URL rules."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

import __spark_entry__ as entry
from tidemark.llm import alignment, repair, urls

BLANK = "[\x20\x09-\x0d]"


def run(spark, name: str, d: str) -> list:
    return next(q for n, q in entry.queries().items() if n.startswith(name + "_"))(spark, d).collect()


def written(spark, tmp_path, name: str, rows: list, schema: str) -> str:
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- op11


def tokens_of() -> tuple:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(alignment.A_PATH), SentencePieceProcessor(model_file=alignment.B_PATH)
    a.encode_special_tokens = True
    byte_of = alignment._byte_of()

    def both(text: str | None) -> tuple[list, list]:
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False)
        own_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in x.ids]
        own_b = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            own_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()))
        whole = (" " + text).encode()
        return (own_a, own_b) if b"".join(p for _, p in own_a) == whole == b"".join(p for _, p in own_b) else ([], [])

    return both


def alignments(docs: list) -> Counter:
    both, links, rows = tokens_of(), Counter(), []
    for doc_id, text in docs:
        a, b = both(text)
        ends = [[0, *itertools.accumulate(len(p) for _, p in side)][1:] for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        own = [(a[i][0], b[j][0]) for i, x in enumerate(ends[0]) for j in ([ends[1].index(x)] if x in set(ends[1]) else [])] if len(a) < 3000 else None
        if own is None:
            at = {x: b[j][0] for j, x in enumerate(ends[1])}
            own = [(a[i][0], at[x]) for i, x in enumerate(ends[0]) if x in at]
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = [], []
            while i < len(a) and ends[0][i] <= c:
                x.append(str(a[i][0]))
                i += 1
            while j < len(b) and ends[1][j] <= c:
                y.append(str(b[j][0]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        links.update(own)
        rows.append((doc_id, len(a), len(b), len(cuts), own, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return Counter((d, n, m, g, len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(s.encode()).hexdigest() if s else "") for d, n, m, g, own, s in rows)


ODD = [None, "", " ", "x", "<|endoftext|> and <s> and </s> <unk>", "a\u2581b", "é\U0001f600\U00013000", "\0\x01 \x7f", "\n\n\t  x  ", " " * 3000 + "q", "\n" * 2500, "ß" * 400, "word " * 20_000, "don't I'LL we've", "中文字符とかな 한국어", "a\ufffdb", "0123456789abcdef" * 500, "x" * 40_000]


def test_alignment_of_odd_texts(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "x"), (None, "no id"), (None, None)]
    d = written(spark, tmp_path, "documents", [(i, t, 9, b"z", "g") for i, t in docs], "doc_id long, text string, n_a int, links binary, groups string")
    assert Counter(map(tuple, run(spark, "op11", d))) == alignments(docs)


def test_alignment_of_the_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, run(spark, "op11", sf_dir))) == alignments(docs)


def test_alignment_in_any_blocks_and_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    whole, cut = (Counter(tuple(map(str, r)) for r in alignment.aligned(docs, ["doc_id"], block=n).collect()) for n in (10**9, 1))
    assert whole == cut
    d = written(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert run(spark, "op11", d) == []


def test_texts_that_are_not_utf8_have_no_tokens():
    n_a, n_b, n_groups, n_links, groups, links = alignment.align_block([b"a\xffb", b"ab"], alignment.A_PATH, alignment.B_PATH)
    assert (n_a[0], groups[0], links[0]) == (0, "", b"") and n_a[1] > 0 and n_groups[1] == n_links[1] == len(links[1]) // 4


def test_both_libraries_of_a_agree_on_all_code_points():
    fast, own = alignment.side_a(alignment.A_PATH), alignment.own_a(alignment.A_PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1{c}{c} {c}b  " for c in points[i : i + 997]) for i in range(0, len(points), 997)]
    assert all(x == own(" " + t) for t, x in zip(texts, fast.encode(texts)))


# --- op12


def damage(rows: list) -> dict:
    out: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def fault_of(text: str, again: bool) -> str:
    seen = re.sub(f"^{BLANK}+|{BLANK}+$", "", text)
    return "blank" if not seen else "duplicate" if again else "truncated" if seen[-1] not in ".!?" else ""


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, list]:
    """The least of all repairs by (cost, audit), by relaxing whole edit strings turn by turn. Rows: role, text, fault."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(best: dict) -> dict:
        for _ in range(4):
            for state, (cost, audit, made) in list(best.items()):
                for x in "ua":
                    if x in moves[state]:
                        new = (cost + 5, audit + "I", made + [(names[x], "")])
                        if x not in best or new[:2] < best[x][:2]:
                            best[x] = new
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after: dict = {}

        def put(state: str, new: tuple) -> None:
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, made) in best.items():
            put(state, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] in moves[state]:
                put(moves[state][role[:1]], (cost + more, audit + "K", made + [(role, text)]))
            for x in "ua":
                if x in moves[state]:
                    put(x, (cost + 1 + more, audit + "R", made + [(names[x], text)]))
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def repairs(rows: list) -> Counter:
    found = Counter()
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own, seen, faults = after.get(conv, []), set(), []
        for _, role, text in own:
            faults.append(fault_of(text, (role, text) in seen))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, audit, made = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        found[(conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)] += 1
    return found


TURNS = "conv_id long, turn long, role string, text string"


def test_repair_of_the_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, run(spark, "op12", sf_dir))) == repairs(rows)


def test_repair_of_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why", "  ", "", None, "x.\n", "y \v", "same.", "Ünd \U0001f600?", "long " * 30_000 + ".", "\u00a0"]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "u", "a"]
    rows = [(rng.choice([*range(150), None]), rng.choice([None, *range(9)]), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(1500)]
    rows += [(900, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(4000)] + [(901, None, "user", "only.")] * 3 + [(902, t, "system", "") for t in range(50)]
    alone = next(c for c in range(10_000, 11_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "gone."))
    d = written(spark, tmp_path, "conversations", [(*r, 1, "x") for r in rows], TURNS + ", fault int, audit string")
    found = Counter(map(tuple, run(spark, "op12", d)))
    assert found == repairs(rows)
    assert found[(alone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == 1


def test_every_short_conversation_is_repaired_at_least_cost():
    kinds = [(i, f) for i in ("s", "u", "a", "x") for f in range(4)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            want = cheapest([(i, "t", repair.FAULTS[f]) for i, f in rows])
            assert repair.repair([i for i, _ in rows], bytes(f for _, f in rows)) == want[:2], rows
    rng = random.Random(2)
    for _ in range(3000):
        rows = rng.choices(kinds, k=rng.randint(4, 30))
        assert repair.repair([i for i, _ in rows], bytes(f for _, f in rows)) == cheapest([(i, "t", repair.FAULTS[f]) for i, f in rows])[:2], rows


def test_a_word_holds_all_layers_that_differ():
    """From every state the repair is at most LAYERS - 1 dearer than from the best one, over all words that can arise."""
    seen, todo = set(), [repair.last_word()[0]]
    while todo:
        word = todo.pop()
        if word in seen:
            continue
        seen.add(word)
        assert word >> (4 * (repair.LAYERS - 1)) == 15
        todo += [repair.earlier_word(word, i, f)[0] for i in "suax" for f in range(4)]
    assert len(seen) > 10


def test_repaired_turns_are_those_of_the_digest(spark, sf_dir):
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    reports = repair.diagnosed(rows)
    made = repair.repaired_turns(rows, reports).collect()
    of: dict = defaultdict(list)
    for r in sorted(made, key=lambda r: (r.conv_id, r.seq)):
        of[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.repaired_digests(rows, reports).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(of[r.conv_id]).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in of[r.conv_id]))


def test_no_conversation(spark, tmp_path):
    assert run(spark, "op12", written(spark, tmp_path, "conversations", [], TURNS)) == []


# --- op13


def verdict(url: str | None, rules: list, default: str = "allow") -> tuple:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, default)


URLS = [
    None, "", "nothing", "http://", "https://example.com", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://www.example.com/en", "http://a.b.www.example.com/en/1", "http://notexample.com/en/",
    "ftp://x.net/es/?q=://a.com/", "http://x.net/fr/#a", "http://x.net/esp", "http://net/es/", "http://com/", "http://com", "a://b://c.com/", "http://u@h.com:80/", "http://.com/", "http://x..com/", "http://com./", "http://ÉX.com/é\n/x",
    "http://" + "a." * 20_000 + "com/" + "p/" * 20_000, "://example.com/en/", "http://example.com?/en/", "HTTP://M.EXAMPLE.NET/es/\ud7ff",
]


def test_url_rules_on_odd_urls(spark, tmp_path):
    rows = [(i, u, "<p>", "r", 1) for i, u in enumerate(URLS)] + [(2, "nothing", None, "r", 1), (None, "http://x.net/es/", "", "", 0)] * 2
    d = written(spark, tmp_path, "pages", rows, "page_id long, url string, html string, rule string, short int")
    want = Counter((r[0], *verdict(r[1], urls.RULES)) for r in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, "op13", d)) == want


def test_url_rules_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    sql = next(s for n, s in entry.oracle_sql().items() if n.startswith("op13_"))
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, "op13", sf_dir)) == Counter(tuple(r[names.index(n)] for n in ("page_id", "host", "path", "rule", "verdict")) for r in found.fetchall())


def test_any_rules_by_either_join(spark):
    """Paths that end anywhere, hosts and paths beyond the cut shapes, repeated and empty rules."""
    long_path, long_host = "/" + "q" * 400, ".".join("abc"[i % 3] for i in range(200))
    rules = [("com", "/", "allow"), ("com", "/e", "block"), ("x.com", "", "allow"), ("X.com", "/english", "block"), ("com", long_path, "block"), ("com", long_path + "r", "allow"), ("com", long_path[:300], "allow"), (long_host, "/", "block"), (long_host[2:], "", "allow"), ("com", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("org", "/", None)]
    known = [(h, p or "", v) for h, p, v in rules if h and v]
    given = [*URLS, "http://x.com/english/1", "http://y.com/e", "http://x.com", "http://net", f"http://a.com{long_path}rs", f"http://a.com{long_path}", f"http://com{long_path[:350]}", f"http://{long_host}/", f"http://z{long_host}/", f"http://z.{long_host}/x", "http://org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    low = [(h.lower(), p, v) for h, p, v in known]
    want = Counter((i, *verdict(u, low, "unknown")) for i, u in enumerate(given))
    for most in (urls.BROADCAST_BYTES, 0):
        assert Counter(map(tuple, urls.judged(pages, table, "unknown", broadcast_bytes=most).collect())) == want
    assert {r.verdict for r in urls.judged(pages, table.limit(0)).collect()} == {"allow"}
    assert urls.judged(pages.limit(0), table).collect() == []


def test_rules_beyond_a_broadcast_are_joined_by_a_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    table = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = urls.judged(pages, table, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" not in plan and "__salt" in plan
