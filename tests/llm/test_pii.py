import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import regex

from hierfeat.llm import pii

# The plain patterns of the four kinds (fixed values).
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m[0])
    ]


def card(draw):
    head = [draw.randint(0, 9) for _ in range(draw.randint(14, 18))]
    last = next(c for c in range(10) if luhn("".join(map(str, [*head, c]))))
    return re.sub(r"(\d{4})", lambda m: m[1] + draw.choice(["", " ", "-"]), "".join(map(str, [*head, last])))


def texts():
    draw = random.Random(3)
    found = ["".join(draw.choice("a1@.+- ()%_é😀25.0\n") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    found += [
        f"é {card(draw)} x {card(draw)}+1 (555) 123-4567 10.0.0.{draw.randint(200, 300)} a@b.com_c@d.org" for _ in range(150)
    ]
    found += [None, "", "a" * 4000, "1" * 4000, "1." * 2000, "x@" + "a." * 2000 + "b", "1 " * 2000, "+1" + " " * 4000]
    return found


def check(found, cases):
    want = Counter()
    for key, text in cases:
        spans = brute(text)
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, *_ in spans)
        want[key, *(counts[k] for k in PLAIN), hashlib.sha256(plain.encode()).hexdigest(), plain] += 1
    got = Counter()
    for r in found:
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))
        got[r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], base] += 1
    assert got == want


def test_base_spans_equal_the_plain_patterns(spark):
    cases = list(enumerate(texts()))
    check(pii.private_spans(spark.createDataFrame(cases, "doc_id bigint, text string")).collect(), cases)


def test_awkward_table(awkward, rows, empty):
    found = pii.private_spans(awkward).collect()
    check(found, [(d, t) for d, t, *_ in rows])
    assert pii.private_spans(empty).count() == 0


def test_long_runs_need_no_stack_and_little_time(spark):
    long = ["1 " * 300_000, "x@" + "a." * 200_000 + "b", "a" * 500_000, "1" * 500_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    assert [r["n_email"] for r in pii.private_spans(df).orderBy("doc_id").collect()] == [0, 1, 0, 0]


def revealing():
    """One word stands next to one address in many passages and nowhere else; common words stand there too."""
    draw = random.Random(1)
    marks = ["one", "two", "three", "four", "five", "six"]
    rows = [(i, f"{m} Zebulon wrote {i}x to zed@corp.org about {m}ark things") for i, m in enumerate(marks)]
    rows += [(100 + i, "wrote about things " + " ".join(draw.choice(["alpha", "wrote", "things"]) for _ in range(20))) for i in range(200)]
    # Copies of one passage show nothing.
    return rows + [(400 + i, "the Solitary word me@corp.org said") for i in range(9)]


def test_words_that_reveal_a_value_are_found(spark):
    df = spark.createDataFrame(revealing(), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.private_spans(df).collect()}
    for key, text in revealing():
        spans = [s.split(":") for s in found[key]["spans"].split(",") if s.startswith("term")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == (["Zebulon"] if key < 6 else [])
        assert found[key]["n_term"] == len(spans)


def test_sanitised_text(spark):
    df = spark.createDataFrame([*revealing(), (900, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert found[0] == "one  wrote 0x to [EMAIL] about oneark things"
    assert found[400] == "the Solitary word [EMAIL] said" and found[900] is None


def test_main_path_is_without_python(awkward):
    plan = pii.private_spans(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*")


def plain_terms(text):
    """Words by plain rules: place and lower-case form."""
    found = []
    for m in WORD.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() :]
        punct = regex.compile(r"\p{P}")
        opens = not before or before.isspace() or (punct.match(before) and before not in "@._%+-/'’")
        joined = after[:1] == "." and after[1:2] and not (after[1].isspace() or (punct.match(after[1]) and after[1] not in "@._%+-/"))
        closes = not after or after[0].isspace() or (punct.match(after[0]) and after[0] not in "@_%+-/" and not joined)
        n = len(regex.sub("[-'’]", "", m[0]))
        named = n == 2 and regex.match(r"[\p{Lu}\p{Lo}][\p{L}\p{M}\p{N}]", m[0])
        if opens and closes and (n > 2 or named) and regex.search(r"\p{L}", m[0]):
            found.append((m.start(), m.end(), m[0].lower()))
    return found


def brute_shares(rows):
    """Revealing words with their largest share, by counting texts."""
    cases = [(i, t or "") for i, (_, t) in enumerate(rows)]
    words = {i: {w for *_, w in plain_terms(t)} for i, t in cases}
    texts, m = sum(1 for w in words.values() if w), Counter(w for own in words.values() for w in own)
    holders, near, passages = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in cases:
        for kind in PLAIN:
            spans = [s for s in brute_all(t, kind)]
            for a, b, left, right in spans:
                if not passes(kind, t[a:b]):
                    continue
                value = kind, t[a:b].lower()
                holders[value].add(i)
                lead, tail = t[max(left, a - 160) : a], t[b : min(right, b + 160)]
                if a - left > 160:
                    lead = re.sub(r"^\S*", "", lead)
                if right - b > 160:
                    tail = re.sub(r"\S*$", "", tail)
                for w in {w for part in (lead, tail) for *_, w in plain_terms(part)}:
                    near[value, w].add(i)
                    passages[value, w].add((lead[-80:], tail[:80]))
    shares = {}
    for (value, w), own in near.items():
        n, k = len(holders[value]), min(len(own), m[w])
        bits = math.log2(max(texts, 2) / n)
        if len(passages[value, w]) >= 3 and bits > 0:
            share = math.log2(k * max(texts, 2) / (n * m[w])) / bits
            if share >= 0.85:
                shares[w] = max(share, shares.get(w, 0))
    return shares


def brute_all(text, kind):
    """Matches of a kind with the ends of the matches before and after."""
    found = [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text)]
    ends, starts = [0, *(b for _, b in found)], [*(a for a, _ in found[1:]), len(text)]
    return [(a, b, left, right) for (a, b), left, right in zip(found, ends, starts)]


def corpus():
    draw = random.Random(6)
    plain = "the and about paper river stone letter wrote office monday said".split()
    names = ["Zorbavek", "O'Neil", "Jean-Luc", "Li", "Müller", "ब्रह्म", "k9-unit", "rare"]
    rows = []
    for i in range(260):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 60))]
        if i % 5 == 0:
            who = i // 5 % len(names)
            place = draw.randint(0, len(words))
            far = draw.randint(0, 9)
            words[place:place] = [names[who], *["so"] * far, f"user{who}@corp.org", draw.choice(["", "10.0.0.1,", "user0@corp.org"])]
        if i % 17 == 0:
            words.insert(0, f"Yesterday {draw.choice(names)} went home, ({draw.choice(names)}) did")
        rows.append((i, " ".join(words) + draw.choice(["", ".", " user3@corp.org"] if i % 50 == 0 else [""])))
    return rows


def test_shares_and_places_equal_a_plain_count(spark):
    rows = corpus()
    shares = brute_shares(rows)
    assert len(shares) >= 4
    found = {r["doc_id"]: r["spans"] for r in pii.private_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for key, text in rows:
        want = [f"term:{a}:{b}" for a, b, w in plain_terms(text) if w in shares]
        assert [s for s in found[key].split(",") if s.startswith("term")] == want


def far_away():
    names = ["one", "two", "three", "four", "five", "six"]
    rows = [(i, f"Zorbavek {n} is the name of whoever may read the {n} letters at z.orb@corp.org today") for i, n in enumerate(names)]
    rows += [(50, "Yesterday Zorbavek went home, and then ZORBAVEK came back. Not Zorbaveks, nor x.Zorbavek@y")]
    return rows + [(100 + i, f"is the name of whoever may read the letters at home today and then {i}x") for i in range(200)]


def test_every_occurrence_of_a_revealing_word(spark):
    """Far from the value within its passage, and in texts without any value."""
    df = spark.createDataFrame(far_away(), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.private_spans(df).collect()}
    for key, text in far_away():
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)(?<![\w.])zorbavek(?!\w)", text)]
        assert [s for s in found[key]["spans"].split(",") if s.startswith("term")] == want
    gone = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert not re.search(r"(?i)\bzorbavek\b", gone[50].replace("x.Zorbavek@y", "")) and "Zorbaveks" in gone[50]


def test_many_revealing_words_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    sent = sorted(map(tuple, pii.private_spans(df).collect()))
    monkeypatch.setattr(pii, "SENT_TERMS", 0)
    assert sorted(map(tuple, pii.private_spans(df).collect())) == sent
