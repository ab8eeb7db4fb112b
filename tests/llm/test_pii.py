import hashlib
import re

import pytest

from tessera.llm import pii
from tests.llm.helpers import ODD, documents, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """The contract, literally."""
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"),
                "card": 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


HARD = [
    "a@b.c d@e f.g@h.i.j. x@@y.z a@b@c.d me@x.y@z.w",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3.4567 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005, 12345678901234567890123",
    "+1 (212) 555-0100 +49 30 123456 ++1 234 567 8901 +1 2 3) 4( +1--------2222222222",
    "call +1 212 555 0100 4111 1111 1111 1111 mailé josé@ex.com \U0001f600 a@b.co",
    "1.1.1.1 1.1.1.1 1.1.1.1 a@b.c a@b.c",
    "0.0.0.0.1.1.1.1 1..2.3.4 .1.2.3.4.",
    "@a.b a@.b a@b. a@b.. a@b.-",
    "- 4111-1111 1111-1111- 4111",
]


@pytest.mark.parametrize("extra", [False, True])
def test_base_spans_equal_the_contract(spark, sf_dir, extra):
    rows = ODD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(HARD)] + [(200, ("x" * 50_000 + " a@b.c ") * 3, "en", "a", 0)]
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source, 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = documents(spark, rows, extra)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in pii.find(docs).collect():
        want = base_spans(texts[r.doc_id][0])
        got = [(pii.KINDS[x.k], x.s, x.e) for x in r.base]
        assert got == want, (r.doc_id, got, want)
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_digest_of_base_spans(spark, sf_dir):
    for r in pii.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(r.text))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_method_adds_spans_it_is_sure_of(spark):
    rows = [(i, f"{prose(i, 20)}\nContact: user{i}@example.com or tel: +1 (212) 555-01{i:02d}", "en", "a", 0) for i in range(60)]
    rows += [(100 + i, f"{prose(i, 20)}\nemail: some{i} [at] example [dot] com", "en", "a", 0) for i in range(40)]
    found = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert all(len(found[i].base) == 2 for i in range(60))
    assert all(not found[100 + i].base for i in range(40))
    assert sum(len(found[100 + i].spans) for i in range(40)) >= 30


def test_redaction(spark):
    docs = documents(spark, [(1, "write to a.b@example.com é or +1 (212) 555-0100!", "en", "a", 0), (2, None, "en", "a", None), (3, "nothing here", "en", "a", 12)], extra=True)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "write to [EMAIL] é or [PHONE]!"
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "nothing here"
    assert pii.redact(docs).columns == docs.columns


def test_empty_table(spark):
    docs = documents(spark, [])
    assert pii.find(docs).count() == 0 and pii.redact(docs).count() == 0


def test_loose_matches_stand_where_their_pattern_does(spark):
    texts = ["+1 555-123-4567 or 555-123-4567", "x555-123-4567, 555-123-4567\nand (555) 123-4567 " + "a" * 50_000]
    docs = documents(spark, list(enumerate(texts)))
    for r in docs.selectExpr("text", f"filter({pii.candidates()}, c -> c.shape = 1 and c.k = 3) as c").collect():
        want = [m.span() for m in re.finditer(pii.LOOSE["phone"], r.text)]
        assert want and [(c.s, c.e) for c in r.c] == want
        assert all(r.text[c.s : c.e] == c.m for c in r.c)


def test_spans_follow_the_rules(spark, sf_dir):
    """Added spans are matches of a pattern, overlap nothing and are in order; base spans all stay."""
    added = 0
    rows = [(r.doc_id, r.text, "en", "a", 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(50_000 + i, f"{prose(i, 20)} email: some{i} [at] example [dot] com, tel: 212-555-01{i:02d} or +1 212-555-01{i:02d}", "en", "a", 0) for i in range(60)]
    texts = {r[0]: r[1] for r in rows}
    for r in pii.find(documents(spark, rows)).collect():
        base, spans = [tuple(x) for x in r.base], [tuple(x) for x in r.spans]
        assert spans == sorted(spans) and set(base) <= set(spans)
        new = [x for x in spans if x not in base]
        added += len(new)
        for s, k, e in new:
            piece = texts[r.doc_id][s:e]
            assert any(re.fullmatch(p.replace("++", "+").replace(r"(?:\G|", "(?:"), piece) for p in [pii._BASE[pii.KINDS[k]][0], pii.LOOSE.get(pii.KINDS[k], "x^")] if p), piece
            assert not any(s < e2 and s2 < e for s2, _, e2 in spans if (s2, e2) != (s, e))
    assert added >= 60


def test_texts_of_very_many_spans(spark):
    """Positions, spans and redaction of long texts, in time that grows about as the text does."""
    import time

    took = []
    for n in (6_000, 24_000):
        text = "".join(f"é{i}@ex.com, +1 212 555 {i % 10000:04d}; 10.0.{i % 256}.{i // 256} \U0001f600 " for i in range(n))
        docs = documents(spark, [(1, text, "en", "a", 0)])
        began = time.time()
        r = pii.find(docs).collect()[0]
        out = pii.redact(docs).collect()[0].text
        took.append(time.time() - began)
        want = base_spans(text)
        assert [(pii.KINDS[x.k], x.s, x.e) for x in r.base] == want
        at, parts = 0, []
        for x in r.spans:
            if x.s >= at:
                parts += [text[at : x.s], f"[{pii.KINDS[x.k].upper()}]"]
            at = max(at, x.e)
        assert out == "".join([*parts, text[at:]])
    assert took[1] < 8 * took[0] and took[1] < 60, took
