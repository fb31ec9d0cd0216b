from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from datetime import date, timedelta

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from graphkiln.llm import mixing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "It was the best of times, it was the worst of times, and the people of the city went on to live in the hope that it is for the good of a nation. "


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    at = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at)


def test_quality_figures(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "x\nx\n x\n\n\n", GOOD, GOOD * 3, "ab cd " * 40, "# * $ | é ß 漢", "a a a a a", "漢字" * 300, ("w%d " * 60) % tuple(range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("_q", F.lit(2))
    out = quality.judge(df).select("doc_id", "_q.*", "base_failed", "kept").collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, symbols, dup, rep = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)


def test_quality_verdict(spark):
    clean = "Many people of the old town went to the market in the morning and it was clear that a new day had come for all of them, on a street that is long. She said that the bread was good and that the price of it is low, so he took some to the house in which they live. After that the rain came to the hills and the river rose, and it was on the third day of May."
    junk = " ".join(f"{w}###$$$ |" for w in "lorem ipsum dolor sit amet elit sed do eiusmod tempor".split() for _ in range(1)) + " " + " ".join(f"@{k}%%~{k}^" for k in range(80))
    df = spark.createDataFrame([(1, clean), (2, junk), (1, clean)], "doc_id long, text string").withColumn("extra", F.lit("e"))
    assert sorted((r.doc_id, r.kept, r.base_failed) for r in quality.judge(df).collect()) == [(1, True, False), (1, True, False), (2, False, False)]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert quality.keep_good(df.limit(0)).count() == 0


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def changed(spark, texts, key="k1"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def to_base(v, base, n):
    out = ""
    for _ in range(n):
        v, d = divmod(v, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def brute_string(text, base, tweak, key):
    halves = [text[: len(text) // 2], text[len(text) // 2 :]]
    for r in range(pii.ROUNDS):
        x, other = halves[r % 2], halves[1 - r % 2]
        seed, out = sha(key, tweak, r, other), ""
        for i in range(0, len(x), pii.WORD):
            w = x[i : i + pii.WORD]
            out += to_base((int(w, base) + int(sha(seed, i // pii.WORD)[:15], 16)) % base ** len(w), base, len(w))
        halves[r % 2] = out
    return "".join(halves)


def brute_rank(l, x, a, b, tweak, key):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            l = (l + int(sha(key, tweak, r, x)[:15], 16)) % a
        else:
            x = (x + int(sha(key, tweak, r, l)[:15], 16)) % b
    return l, x


def luhn_digit(payload):
    d = [int(c) for c in payload][::-1]
    return str(-(sum(x * 2 - 9 * (x > 4) for x in d[::2]) + sum(d[1::2])) % 10)


def filled(text, chars, new):
    new = iter(new)
    return "".join(next(new) if c in chars else c for c in text)


def brute_pseudonym(kind, m, key):
    """What a value of a kind becomes, written from the docstring; None if it isn't valid."""
    digits, d = "0123456789", re.sub("[^0-9]", "", m)
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        l, r = brute_rank(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip:0", key)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        l, r = brute_rank((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn:0", key)
        area = l // 99 + 1
        return f"{area + (area >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if kind == "date":
        parts, marks = re.split(r"[/.\-]", m), re.findall("[^0-9]", m)
        for form in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
            at = dict(zip(form, map(int, parts), strict=True))
            try:
                day = (date(at["y"], at["m"], at["d"]) - date(1800, 1, 1)).days
            except ValueError:
                continue
            if not 0 <= day < pii.DATES:
                continue
            l, r = brute_rank(day // 773, day % 773, pii.DATES // 773, 773, "date:0", key)
            new = date(1800, 1, 1) + timedelta(l * 773 + r)
            short = any(len(p) == 1 for p in parts)
            out = {"y": str(new.year), "m": f"{new.month:{'' if short else '02'}d}", "d": f"{new.day:{'' if short else '02'}d}"}
            return out[form[0]] + marks[0] + out[form[1]] + marks[1] + out[form[2]]
        return None
    if kind == "number":
        known = len(d) == 16 or (d[0] == "3" if len(d) in (14, 15) else d[0] in "456")
        if not known or luhn_digit(d[:-1]) != d[-1]:
            return None
        new = brute_string(d[:-1], 10, f"number:{len(d) - 1}", key)
        return filled(m, digits, new + luhn_digit(new))
    if kind == "iban":
        solid = m.replace(" ", "")
        rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if rest(solid) != 1:
            return None
        account = re.sub("[^0-9]", "", solid[4:])
        new = filled(solid[4:], digits, brute_string(account, 10, f"iban:{len(account)}:{solid[:2]}{re.sub('[^A-Z]', '', solid[4:])}", key))
        return filled(m, digits + string.ascii_uppercase, f"{solid[:2]}{98 - rest(solid[:2] + '00' + new):02d}{new}")
    if kind == "secret":
        new = brute_string(m.lower(), 16, f"secret:{len(m)}", key)
        return new.upper() if m == m.upper() else new
    if kind == "email":
        local, domain = m.lower().split("@")
        code = re.sub("[^a-z0-9]", "", local)
        tweak = f"email:{len(code)}:{re.sub('[ -~]', '', local)}"
        seed = sha(key, "letters", local)
        local = filled(local, digits + string.ascii_lowercase, brute_string(code, 36, tweak, key))
        return "".join(c if c < "\x80" else chr(97 + int(sha(seed, i)[:8], 16) % 26) for i, c in enumerate(local)) + "@" + domain
    return m


#: The search pattern with named groups, and a name for the one that is referred to.
PII = regex.compile("|".join(f"(?P<{k}>{p})" if k != "number" else "(?P<number>" + p.replace(r"([ \-])", r"(?P<gap>[ \-])").replace(r"\1", "(?P=gap)") + ")" for k, p in pii.PATTERNS.items()))


def brute_text(text, key):
    """All kinds but telephone numbers, whose ends depend on the country; they must keep their form."""
    if text is None:
        return None
    return PII.sub(lambda m: re.sub("[0-9]", "#", m[0]) if m["phone"] else brute_pseudonym(next(k for k in pii.PATTERNS if m[k]), m[0], key) or m[0], text)


def without_phones(text, given):
    """``text`` with the digits of what was a telephone number in ``given`` masked."""
    if text is None:
        return None
    masked = list(text)
    shift = 0
    for m in PII.finditer(given):
        kind = next(k for k in pii.PATTERNS if m[k])
        if kind == "phone":
            for i in range(m.start() + shift, m.end() + shift):
                masked[i] = "#" if masked[i].isdigit() else masked[i]
        else:
            shift += len(brute_pseudonym(kind, m[0], "k1") or m[0]) - len(m[0])
    return "".join(masked)


def test_pii_against_brute_force(spark):
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    texts += ["a 3/7/2021 b 2021-12-31 c 31.02.2021 d 1/13/1999", "078-05-1120 666-12-1234 899-99-9999", "AT611904300234573201 EUR and ES91 2100 0418 4502 0005 1332 BIC", "GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433", "4111-1111-1111-1111 3782 822463 10005 1700000000000", "Ann.Lee+x@Mail.example.com, enßpf.55@a-b.example.com and x@y", "K=" + "0123456789ABCDEF" * 9, "10.0.0.1 1.2.3.4.5 999.1.1.1", "d" * 11 + "1" * 11 + "@x.de"]
    out = changed(spark, texts)
    assert sum(a != b for a, b in zip(texts, out, strict=True)) > 50
    for a, b in zip(texts, out, strict=True):
        assert without_phones(b, a) == brute_text(a, "k1")


def test_pii_cases_that_leaked(spark):
    texts = ["x@a" + ".a" * 3000, "AT611904300234573201 EUR 50", "ES9121000418450200051332 BIC XX", "AT61 1904 3002 3457 3201 EUR 50", "0123456789ab" * 11, "a" * 200 + "@b.org", "212-555-0199"]
    out = changed(spark, texts)
    assert not any(a == b for a, b in zip(texts, out, strict=True)) and list(map(len, out)) == list(map(len, texts))
    assert out[1].endswith(" EUR 50") and out[2].endswith(" BIC XX") and out[1][:20] == out[3].replace(" ", "")[:20]
    assert not any(c in out[4] for c in ("0123456789ab" * 2, "ab" * 12))
    stay = ["at 1700000000000 ms", "order 123456789012", "9807915762804490", "123-456-7890", "XX611904300234573201", "1" * 200, "ab" * 200, "20240115103000"]
    assert changed(spark, stay) == stay


def test_pii_very_long_values(spark):
    texts = ["a" * 1_000_000 + "@b.org", "x@" + "a." * 500_000 + "de", "0123456789abcdef" * 62_500, "1" * 1_000_000, "1-" * 500_000, "4111 " * 200_000, "é" * 300_000 + "@x.org"]
    out = changed(spark, texts)
    assert list(map(len, out)) == list(map(len, texts)) and [a == b for a, b in zip(texts, out, strict=True)] == [False, False, False, True, True, True, False]


def test_pii_needs_a_key(spark):
    with pytest.raises(ValueError, match="key"):
        changed(spark, ["x"], key="")


def test_pii_formats(spark):
    texts = ["pay 4111 1111 1111 1111 or 4111111111111111.", "4845168114407329", "tel +1 (017) 555-7713", "10.20.30.40", "ssn 078-05-1120", "born 1984-02-29, 25/12/1999", "DE89 3704 0044 0532 0130 00", "Ann.Lee+x@Mail.example.com", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "enßpf.55@mail4.example.com"]
    out = changed(spark, texts)
    assert not any(a == b for a, b in zip(texts, out, strict=True))
    a, b = re.search(r"pay (\d{4} \d{4} \d{4} \d{4}) or (\d{16})\.$", out[0]).groups()
    assert a.replace(" ", "") == b and luhn_ok(b)
    assert re.fullmatch(r"\d{16}", out[1]) and luhn_ok(out[1]) == luhn_ok(texts[1])
    assert re.fullmatch(r"tel \+1 \(\d{3}\) \d{3}-\d{4}", out[2])
    assert all(0 <= int(x) < 256 for x in out[3].split("."))
    area = int(re.fullmatch(r"ssn (\d{3})-\d{2}-\d{4}", out[4]).group(1))
    assert 0 < area < 900 and area != 666
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4}", out[5])
    flat = out[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{3}\+[a-z0-9]@mail\.example\.com", out[7])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[8])
    assert re.fullmatch(r"[a-z0-9]{5}\.[a-z0-9]{2}@mail4\.example\.com", out[9])


def test_pii_links_and_separates(spark):
    same = changed(spark, ["x a@b.org y", "A@B.ORG", "5500000000000004 5500-0000-0000-0004"])
    assert same[0].split()[1] == same[1]
    first, second = same[2].split()
    assert first == second.replace("-", "")
    ips = changed(spark, [f"10.0.{k // 256}.{k % 256}" for k in range(600)])
    assert len(set(ips)) == 600
    dates = changed(spark, [f"2001-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)])
    assert len(set(dates)) == 12 * 28
    assert changed(spark, ["10.0.0.1"], key="other") != changed(spark, ["10.0.0.1"])


def test_pii_leaves_the_rest(spark):
    texts = [None, "", "plain text", "version 3. CC BY-NC 4.0", "2023-02-30", "DE00370400440532013000", "call 12345", "a" * 50_000, "1.2.3.4.5", "x @ y"]
    assert changed(spark, texts) == texts
    df = spark.createDataFrame([(1, "a@b.org", "k")], "doc_id long, text string, _found string")
    assert [(r.doc_id, r._found) for r in pii.pseudonymise(df, "k1").collect()] == [(1, "k")]
    df = df.limit(0)
    assert pii.pseudonymise(df.select("doc_id", "text"), "k1", report="r").columns == ["doc_id", "text", "r"]


def iban(country, account):
    number = lambda c: int("".join(str(int(x, 36)) for x in account + country + c))
    return f"{country}{98 - number('00') % 97:02d}{account}"


def test_pii_long_ibans(spark):
    french, italian = "20041010050500013M02606", "X0542811101000000123456"
    accounts = [french, *[french[:-3] + f"{k:03d}" for k in range(300)], "2" + french[1:-1] + "7", italian]
    given = [*(iban("FR", a) for a in accounts), iban("RU", "1" * 29)]
    assert given[0] == "FR1420041010050500013M02606"
    out = changed(spark, given)
    assert len(set(out)) == len(set(given))
    for a, b in zip(given, out, strict=True):
        assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
        assert a[4:14] != b[4:14] and re.sub("[A-Z]", "", a)[-11:] != re.sub("[A-Z]", "", b)[-11:]
    assert len({b[-5:] for b in out}) > 250
    spaced = changed(spark, [" ".join(re.findall(".{1,4}", given[0]))])
    assert spaced[0].replace(" ", "") == out[0]


def test_pii_written_forms(spark):
    shape = lambda x: re.sub("[0-9]", "0", x)
    dates = ["3/7/2021", "7.3.2021", "2021/03/07", "03-07-2021", "2021-3-7", "12-31-1999"]
    out = changed(spark, [f"on {x}." for x in dates])
    for a, b in zip(dates, out, strict=True):
        assert a not in b and re.sub("[0-9]+", "0", b) == re.sub("[0-9]+", "0", f"on {a}."), (a, b)
    assert len(set(changed(spark, [f"{d}.{m}.2001" for m in range(1, 13) for d in range(1, 29)]))) == 12 * 28
    card = changed(spark, ["3782 822463 10005", "378282246310005"])
    assert shape(card[0]) == "0000 000000 00000" and luhn_ok(card[0]) and card[0].replace(" ", "") == card[1] != "378282246310005"
    phones = ["+44 20 7946 0958", "+49 30 901820", "06 12 34 56 78", "020 7946 0958", "030/901820", "(030) 901820", "+33 6 12 34 56 78", "+49 (0)30 901820", "612 34 56 78", "0049 30 901820", "+34 612 345 678"]
    out = changed(spark, [f"tel {x} 3.7.2021" for x in phones])
    for a, b in zip(phones, out, strict=True):
        assert a not in b and "3.7.2021" not in b and shape(b).startswith(f"tel {shape(a)} "), (a, b)
    flat = [re.sub("[^0-9]", "", x.split("tel ")[1][: len(p)]) for x, p in zip(out, phones, strict=True)]
    assert flat[0][2:] == flat[3][1:] and flat[2][1:] == flat[6][2:] and flat[1][2:] == flat[4][1:] == flat[5][1:] == flat[7][3:] == flat[9][4:]
    assert flat[0][:2] == "44" and flat[1][:2] == "49" and flat[8] == flat[10][2:]
    kept = ["30/2/2021", "99-99-2021", "at 10:05:07.123456 it", "0.123456789", "1.2.3-rc4", "pages 07-12", "1 612 345 678 inhabitants"]
    assert changed(spark, kept) == kept


def water(sizes, weights, most):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        open_ = [k for k in range(len(sizes)) if k not in capped]
        level = rest / sum(weights[k] for k in open_) if open_ else 0
        new = {k for k in open_ if weights[k] * level > most * sizes[k]}
        if not new:
            return [most * sizes[k] if k in capped else weights[k] * level for k in range(len(sizes))]
        capped |= new


def test_mixing(spark):
    rows = [(k, "w " * (1 + k % 37), "hot" if k % 3 else f"s{k % 7}", k) for k in range(900)] + [(1000, None, None, 0), (1001, "a b", None, 1), (1002, "", "empty", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long")
    out = mixing.copies(df, "doc_id", "text", "source", [5, 2, 1]).select("_row.doc_id", "_row.source", F.col("_size").alias("size"), "source_size", "target", "_copies").collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, text, source, _ in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r._copies <= 3
        taken[r.source] += r.size * r._copies
    for s in names:
        assert abs(taken[s] - want[s]) <= 37
    again = mixing.copies(df.repartition(5), "doc_id", "text", "source", [5, 2, 1]).select("_row.doc_id", "_copies").collect()
    assert sorted((r.doc_id, r._copies) for r in out) == sorted((r.doc_id, r._copies) for r in again)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r._copies for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_many_sources(spark):
    choose = random.Random(2)
    rows = [(k, "w " * choose.randrange(1, 60), f"s{choose.randrange(200)}") for k in range(1500)]
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    names = sorted(size)
    want = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", [5, 2, 1]).select("_row.source", "target").collect()
    assert all(r.target == pytest.approx(want[r.source]) for r in out) and len(out) == 1500


def test_sharding(spark):
    names = [f"n{k}" for k in range(7)]
    table = sharding.fill(names)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill(names[:-1], len(table))
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a < 6)
    assert moved < 0.2 * len(table)
    odd = spark.createDataFrame([(str(k), k) for k in range(30)], "slot string, `a.b` long")
    placed = sharding.assign(odd, "slot", names)
    assert placed.columns == ["a.b", "slot", "shard"] and placed.count() == 30
    assert [r.shard for r in placed.orderBy("`a.b`").collect()] == [r.shard for r in sharding.assign(odd.withColumnRenamed("slot", "k"), "k", names).orderBy("`a.b`").collect()]
    assert sharding.assign(odd, "a.b", names).columns == ["a.b", "slot", "shard"]
    df = spark.createDataFrame([(k % 50, "x") for k in range(200)] + [(None, "y")], "doc_id long, slot string")
    out = sharding.assign(df, "doc_id", names).collect()
    assert len(out) == 201 and {r.shard for r in out} <= set(names)
    assert len({(r.doc_id, r.shard) for r in out}) == 51
    with pytest.raises(ValueError, match="distinct"):
        sharding.fill(["a", "a"])
    assert sharding.assign(df.limit(0), "doc_id", names).count() == 0
