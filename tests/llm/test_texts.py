"""Operators 1, 2, 3, 6, 9 and 10 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, langid, pii, quality, secret_scan, tokens, warc
from ebbtide.session import scratch_path
from tests.llm.conftest import prose, rows


# ---------------------------------------------------------------- 1

def test_url_keys_and_ids():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://example.org:8443") == "org,example:8443)/"
    assert [warc.url_key(u) for u in (None, "", "no host", "http://[bad")] == ["", "", "no host", "http://[bad"]
    assert [warc.page_id_of(warc.record_id(i)) for i in (0, 5, -3, None, 2**62)] == [0, 5, -3, None, 2**62]


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 60
    pages = [(5, "http://b.com/x", long), (2, "http://a.com/", long), (9, None, long), (3, "http://a.com/", "short"), (4, "http://a.com/", "short"),
             (7, "http://c.com", None), (8, "http://c.com", "z" * 300000), (2, "http://a.com/", long), (None, "http://d.com", long), (None, None, None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = collections.Counter(map(tuple, warc.round_trip(df).collect()))
    want = collections.Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        first = 2 if i is not None and h == long and i > 2 else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_blocks_and_lookup(spark, tmp_path, monkeypatch):
    captures = [(f"com,h{i % 40:02d})/", i // 3, "f", i, 1) for i in range(3000)]
    df = spark.createDataFrame(captures, "url_key string, page_id long, file string, offset long, length long").repartition(4)
    parts = [tuple(r) for r in warc.write_index(df, str(tmp_path), block=16).collect()]
    monkeypatch.setattr(warc, "TASK_KEYS", 400)
    split = tmp_path / "split"
    assert len(warc.write_index(df, str(split), block=16).collect()) > 4  # the ranges follow the number of keys
    index = warc.Index(str(tmp_path), parts)
    for key, page in {c[:2] for c in captures[::7]} | {("com,none)/", 1), ("", None)}:
        assert sorted(o for _, o, _ in index.find(key, page)) == sorted(c[3] for c in captures if c[:2] == (key, page))


def test_records_are_read_by_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 4000)
    monkeypatch.setattr(warc, "TASK_KEYS", 50)
    pages = [(i, f"https://h{i % 7}.org/{i}", f"<p>{i}</p>" + prose(i, 60)) for i in range(200)]
    folder = scratch_path(spark, "warc-tasks")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parts = warc.write_index(warc.write_archives(df, folder), folder)
    places = warc.look_up(parts, folder, df.select("url", "page_id"))
    assert places.rdd.getNumPartitions() >= 4
    records = warc.read_records(places, folder)
    assert records.rdd.getNumPartitions() > 4
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in records.collect()) == pages


# ---------------------------------------------------------------- 2

def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_kinds_are_the_patterns_matches():
    r, finder = random.Random(5), pii.Finder()
    for alphabet in ("0123456789..  -@+()abZ%é_", "012345.. -@+a", "01234567890123456789 -+", "4111 "):
        for _ in range(2500):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 70)))
            assert [s for s in finder.spans(t) if s[1] < 4] == base_spans(t), t


def test_added_kinds_and_redaction():
    t = "IBAN DE89 3704 0044 0532 0130 00, account no: 12345678, 12 Oak Hill Road, see https://joe:pw@h.org/x or mailto:me; account is open"
    assert [pii.KINDS[k] for _, k, _ in pii.Finder().spans(t) if k > 3] == ["iban", "account", "address", "link", "link"]
    assert pii.redact_text("x a@b.co, y", pii.Finder().spans("x a@b.co, y")) == "x [EMAIL], y"
    clean = prose(3, 500)
    assert not [s for s in pii.Finder().spans(clean) if s[1] != 2]


def addresses(text):
    return [text[a:b] for a, k, b in pii.Finder().spans(text) if pii.KINDS[k] == "address"]


def test_addresses():
    long_name = "Z" + "z" * 5000
    for want in ("12 Oak Hill Road", "221 Baker St.", "7 Fifth Ave.", "7 Fifth Ave", "3b Élysée Avenue", "12 O'Connell Street", "9 Saint-Martin Ln.",
                 f"5 {long_name} Street", "12 rue Victor Hugo", "12 bis, rue de l'Église", "4 Avenue Foch", "33, boulevard Saint-Germain",
                 "1 allée des Érables", "5 place de la République", "Calle Mayor 5", "Calle de Alcalá, 42", "Avenida de la Constitución 12b",
                 "plaza Mayor, 3", "Paseo del Prado n.º 8", "Hauptstraße 5", f"{long_name}straße 17", "Poststrasse 17a"):
        for text in (want, f"({want})", f"he lives at {want}, they say", f"x; {want}\n"):
            assert addresses(text) == [want], text
    assert addresses("1 rue Hugo, 2 rue Zola et Calle Mayor 5") == ["1 rue Hugo", "2 rue Zola", "Calle Mayor 5"]
    for clean in ("la rue de la paix", "le 12 rue", "12 rue de la paix", "Avenue Foch", "the Road to 12 Places", "on 5 May St John came", "calle mayor 5",
                  "Calle Mayor", "Plaza 5", "12 roads", "Baker Street", "x12 rue Hugo", "123456 rue Hugo", "12 Hugorue Zola", "1 place", "12 oak Road",
                  "12 A B Road", "in 2020 la Rue Hugo", "1 Un Deux Trois Quatre Road", "la calle de Alcalá tiene 42 casas", "Street " * 500, "rue Rue " * 500):
        assert addresses(clean) == [], clean


def test_pii_query(docs, empty):
    got = sorted(map(tuple, pii.digest(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").fillna(-1, "doc_id").collect()))
    want = []
    for d, t, *_ in rows():
        b = base_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((-1 if d is None else d, *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.digest(empty).count() == 0


# ---------------------------------------------------------------- 3

def test_forward_sums_all_segmentations():
    p = langid.Pieces(tokens.vocab_path(langid.VOCAB_FILE))
    probs = np.random.default_rng(0).random((len(p.names), 3)) / len(p.names)
    place = {n: i for i, n in enumerate(p.names)}

    def brute(word):
        a = [np.ones(3)]
        for j in range(1, len(word) + 1):
            total = np.zeros(3)
            for i in range(max(0, j - p.longest), j):
                if word[i:j] in place:
                    total += a[i] * probs[place[word[i:j]]]
                elif j - i == 1:
                    total += a[i] * langid.UNKNOWN
            a.append(total)
        return np.log(a[-1])

    words = ["the", "schönheit", "x", "日本", "theandtionßé" * 2, "zzz日qq", "привет"]
    assert np.allclose(langid.log_likelihoods(p, probs, words), [brute(langid.BEGIN + w) for w in words])
    long = ["abcdefgh" * 500, "theund" * 90 + "日本é" * 40, "x" * langid.LONG_WORD, "zß" * 4000]
    for w in long:  # one by one, and together with others
        assert np.allclose(langid._alone(p, probs, w), [langid._together(p, probs[:, [k]], ["the", w])[1, 0] for k in range(3)])
    mixed = langid.log_likelihoods(p, probs, ["the", *long, "x"])
    assert np.isfinite(mixed).all() and np.allclose(mixed[[0, -1]], [brute(langid.BEGIN + "the"), brute(langid.BEGIN + "x")])
    used = langid.expected_counts(p, probs, ["the", "and"], np.array([0, 2]), np.array([2.0, 1.0]))
    assert used[:, 1].sum() == 0 and used[:, 0].sum() >= 2 and used[:, 2].sum() >= 1


def test_long_runs_of_rare_and_unknown_letters_keep_the_fit_finite(spark):
    p = langid.Pieces(tokens.vocab_path(langid.VOCAB_FILE))
    place = {n: i for i, n in enumerate(p.names)}
    unknown, rare = "\u4e02" * 64, "\u65e5\u672c" * 32
    assert "\u4e02" not in p.code and "\u65e5" in p.code

    def brute(word, probs):  # exact fractions: no range to leave
        from fractions import Fraction
        word, of = langid.BEGIN + word, lambda x: Fraction(float(probs[place[x]])) if x in place else Fraction(langid.UNKNOWN)
        cuts = [(i, j) for i in range(len(word)) for j in range(i + 1, min(len(word), i + p.longest) + 1) if word[i:j] in place or j == i + 1]
        a, b = [Fraction(1)] + [Fraction(0)] * len(word), [Fraction(0)] * len(word) + [Fraction(1)]
        for i, j in cuts:
            a[j] += a[i] * of(word[i:j])
        for i, j in reversed(cuts):
            b[i] += of(word[i:j]) * b[j]
        used = np.zeros(len(p.names))
        for i, j in cuts:
            if word[i:j] in place:
                used[place[word[i:j]]] += float(a[i] * of(word[i:j]) * b[j] / a[-1])
        return used

    probs = np.random.default_rng(1).random((len(p.names), 1)) * 1e-6
    for word in (unknown, rare, "x" + unknown[:20] + "theandtion" + rare[:20], "the"):
        got = langid.expected_counts(p, probs, [word, "and"], np.array([0, 0]), np.array([3.0, 2.0]))[:, 0]
        assert np.allclose(got, 3 * brute(word, probs[:, 0]) + 2 * brute("and", probs[:, 0]))
    texts = [(i, prose(i), "en") for i in range(20)] + [(50, f"river {unknown} stone {rare}", "en"), (51, "der Fluss und die Wolke", "de")]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert np.isfinite(model.probs).all() and np.allclose(model.probs.sum(axis=0), 1)
    names, score = model.scorer().predict(pa.array(["river stone cloud paper light", "und die Wolke"]))
    assert names == ["en", "de"] and np.isfinite(score).all()


def test_number_characters_are_no_letters(spark):
    assert langid.letter_runs("½²①") == [] and langid.letter_runs("a½b²c③d٣e") == ["a", "b", "c", "d", "e"] and langid.letter_runs("it's日本") == ["it", "s日本"]
    rows = [(i, prose(i), "en") for i in range(9)] + [(20, "½ ² ①", "en"), (21, "½ river ² stone", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[20] == ("und", 0.0) and got[21][0] == "en"


def test_langid_held_out_accuracy_and_odd_rows(spark, sf_small, docs, empty):
    real = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = langid.predictions(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    odd = langid.predictions(docs).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {5, 6, 7}
    assert langid.predictions(empty).count() == 0


# ---------------------------------------------------------------- 6

def test_quality_counts(docs, empty):
    def brute(t):
        t = t or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(
        [(100, "a b c d e f " * 9), (101, "x\ny\nx\n\n y\nx"), (102, "a b c d e a b c d e"), (103, "#a $b | <c>")], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.verdicts(more).collect())
    assert got == collections.Counter((r.doc_id, *brute(r.text)) for r in more.collect())
    assert quality.verdicts(empty).count() == 0


def test_quality_finds_the_labelled_junk(spark, sf_small):
    got = quality.verdicts(spark.read.parquet(f"{sf_small}/documents.parquet")).join(spark.read.parquet(f"{sf_small}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert got.where("quality = 0 and kept").count() <= 0.2 * got.where("quality = 0").count()


# ---------------------------------------------------------------- 9

def test_myers_is_the_edit_distance():
    def brute(p, t):
        row = list(range(len(p) + 1))
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
            row = new
            yield row[-1]

    r = random.Random(3)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 80))) for _ in range(2))
        assert list(decontaminate.Myers(p).distances(t)) == list(brute(p, t))


def test_passages_within_the_budget_are_found(spark, docs, empty):
    r, items = random.Random(8), [prose(100 + i, 30) for i in range(5)]
    planted = []
    for i in range(40):
        text, k = list(items[i % 5]), decontaminate.budget(len(items[i % 5]))
        for _ in range(r.randint(0, k)):
            at = r.randrange(len(text))
            text[at:at + r.randint(0, 1)] = r.choice(["", "Q"])
        planted.append((1000 + i, f"{prose(i, 20)} {''.join(text).upper()} {prose(i + 50, 20)}"))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " "), (0, items[0])], "item_id long, text string")
    all_docs = spark.createDataFrame(planted, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = decontaminate.contaminated(all_docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1000 + i, i % 5) for i in range(40)} and len(got) == 40
    assert decontaminate.clean(docs, bench).count() == docs.count() and decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.contaminated(all_docs, bench, block_bytes=300).count() == 40  # several blocks
    assert decontaminate.clean(all_docs, bench, block_bytes=300).count() == docs.count()
    folder, n = decontaminate.item_blocks(bench, block_bytes=40)
    assert n > 10  # some of them empty
    blocks = [decontaminate.read_block(folder, b) for b in range(n)]
    assert sorted(x for b in blocks for x in b) == sorted([*enumerate(items), (10, " ")]) and [] in blocks
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(all_docs, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- 10

def test_secrets(spark, docs, empty):
    r = random.Random(4)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    many = [(200 + i, f"{prose(i, 8)} password={hexes(18)} {prose(i, 4)} order 20240101{i:08d} river{i}stonecloudpaper") for i in range(60)]
    got = secret_scan.scan(docs.select("doc_id", "text", "source").unionByName(
        spark.createDataFrame([(*m, "a/b") for m in many], "doc_id long, text string, source string"))).collect()
    named = [x for x in got if x.before.endswith("password=")]
    assert len(named) == 61 and all(x.secret for x in named)
    assert all(x.secret for x in got if x.value.startswith("AKIA")) and not any(x.secret for x in got if x.value.isdigit())
    assert secret_scan.findings(empty).count() == 0


def test_one_label_alone_decides(spark):
    """Nothing to fit: what the rule calls a secret is one, what it says nothing about is none."""
    texts = [(1, "password=a9f03bc1d2e47f6a55"), (2, "build x9qrstuvwxyz7abcdef end")]
    got = {r.doc_id: (r.label, r.secret) for r in secret_scan.scan(spark.createDataFrame([(*t, "a") for t in texts], "doc_id long, text string, source string")).collect()}
    assert got[1] == (1.0, True) and got[2] == (None, False)


def test_named_values_and_late_digits_are_candidates(spark):
    forms = ['password = "Abc123!x"', "password: Abc123!x", '"password": "Abc123!x"', 'password="Abc123!x"', "password=Abc123!x", "'pwd' => 'Abc123!x'",
             "api-key: Abc123!x", "access_key=Abc123!x", "API_KEY := Abc123!x", "secret Abc123!x", "auth\t'Abc123!x'"]
    late = "x" * 300 + "7" + "y" * 20
    texts = [*enumerate([f"{prose(i, 5)} {f} {prose(i, 3)}" for i, f in enumerate(forms)]), (100, f"see {late} and {'z' * 300}"), (101, "author: someone tokens: none1234")]
    df = spark.createDataFrame([(i, t, "a/b") for i, t in texts], "doc_id long, text string, source string")
    found = {}
    for r in secret_scan.candidates(df, "doc_id", "text", "source").collect():
        found.setdefault(r.doc_id, []).append(r.value)
    assert found == {**{i: ["Abc123!x"] for i in range(len(forms))}, 100: [late]}
    r = random.Random(11)
    many = [(1000 + i, f"{prose(i, 8)} the password should stay, order 20240101{i:08d} password: {r.randrange(16**12):012x} {prose(i, 4)}", "a/b") for i in range(60)]
    got = secret_scan.scan(df.unionByName(spark.createDataFrame(many, df.schema))).collect()
    assert {x.secret for x in got if x.value == "Abc123!x"} == {True} and all(x.named == 1 for x in got if x.value == "Abc123!x")
    assert {x.secret for x in got if x.value == "should"} == {False}


@pytest.mark.parametrize("name", ["quality", "secret_scan"])
def test_native_operators_have_no_python_stage(name, docs):
    plan = {"quality": lambda: quality.counts(docs), "secret_scan": lambda: secret_scan.candidates(docs, "doc_id", "text", "source")}[name]()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
