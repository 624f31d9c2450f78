"""Secrets and harmless tokens by form; from "element" on, surroundings are like those of the training findings."""

import random
import string

import pytest

from meander.llm import secret_scan

RNG = random.Random(5)
FULL, HEX = string.ascii_letters + string.digits, "0123456789abcdef"


def r(n, letters=FULL):
    return "".join(RNG.choice(letters) for _ in range(n))


SECRETS = {
    "environment": lambda: (f"export SERVICE_TOKEN={{}}\n", r(32)),
    "json": lambda: ('{{"secret": "{}", "n": 1}}', r(40, HEX)),
    "wide yaml": lambda: ("db:\n  password:            {}\n  host: a", r(12)),
    "wide before": lambda: ("client_secret                            = {}\n", r(30)),
    "ruby": lambda: (":api_key => '{}'", r(40)),
    "cloud id": lambda: ("we used {} then", "AKIA" + r(16, string.ascii_uppercase + string.digits)),
    "cloud secret": lambda: ("aws_secret_access_key = {}", r(40, FULL + "+/")),
    "push token": lambda: ("push with {} ok", "ghp_" + r(36)),
    "chat token": lambda: ("hook {}.", "xoxb-" + r(11, string.digits) + "-" + r(24)),
    "web token": lambda: ("see {} there", f"eyJ{r(30)}.eyJ{r(60)}.{r(43)}"),
    "key": lambda: ("x\n{}\ny", f"-----BEGIN RSA PRIVATE KEY-----\n{r(1600)}\n-----END RSA PRIVATE KEY-----"),
    "very long key": lambda: ("x\n{}\ny", f"-----BEGIN PRIVATE KEY-----\n{r(100) * 2000}\n-----END PRIVATE KEY-----"),
    "assigned key": lambda: ("private_key = \"{}\"", f"-----BEGIN EC PRIVATE KEY-----\n{r(300)}\n-----END EC PRIVATE KEY-----"),
    "short": lambda: ('password = "{}"', r(9)),
    "letters": lambda: ("secret: {}", r(18, string.ascii_letters)),
    "url": lambda: ("dsn postgres://svc:{}@db.internal/app", r(12)),
    "bearer": lambda: ("curl -H 'Authorization: Bearer {}' x", r(44)),
    "late digit": lambda: ("token={}", r(80, string.ascii_letters) + "7" + r(5)),
    "mixed letters": lambda: ("our token {} works", r(32, string.ascii_letters)),
    "element": lambda: ("<user>bob</user><password>{}</password>", r(7) + "9!q"),
    "attribute": lambda: ('<add key="DbPassword" value="{}" />', r(12) + "4x"),
    "option": lambda: ("mysql --password {} -h db", r(10) + "7k"),
    "long option": lambda: ("deploy --api-key '{}' --now", r(24) + "3a"),
    "user": lambda: ("curl -u svc:{} https://example.org", r(11) + "5Z"),
    "stated": lambda: ("the password is {}, keep it", r(9) + "0r&3x"),
    "stated token": lambda: ("our api key was {} before", r(30) + "1b"),
}
PLAIN = {
    "commit": lambda: f"commit {r(40, HEX)} fixes it",
    "uuid": lambda: f"id: {r(8, HEX)}-{r(4, HEX)}-{r(4, HEX)}-{r(4, HEX)}-{r(12, HEX)} x",
    "path": lambda: "see https://example.org/archive/page_2019_01_02/index.html now",
    "card": lambda: f"card {r(16, string.digits)}",
    "digest after": lambda: f"{r(64, HEX)}  sha256 of file",
    "name": lambda: "class AbstractUserServiceFactoryBean extends",
    "placeholder": lambda: 'password = "your-password-here"',
    "variable": lambda: "token: ${SERVICE_TOKEN_NAME}",
    "word": lambda: "theorderingoftheablest23 ing the",
    "sentence": lambda: "the password is required and the token was rejected, the secret is understanding",
    "variable option": lambda: "run --token $SERVICE_TOKEN --password ${DB_PASSWORD} now",
    "file option": lambda: f"run --password-file /etc/service/auth{r(1, string.digits)}.txt now",
    "element of a name": lambda: "<token>${SERVICE_TOKEN_NAME}</token>",
    "numbers": lambda: f"docker run -u 1000:{r(4, string.digits)} image",
}
EACH = 30


def around(text):
    words = lambda: " ".join(r(RNG.randint(2, 8), "etaoinshrdlu") for _ in range(6))
    return f"{words()} {text} {words()}"


def test_recall_by_form(spark):
    rows, whole = [], {}
    for form, make in SECRETS.items():
        for _ in range(EACH if form != "very long key" else 2):
            frame, secret = make()
            key, text = len(rows), around(frame.format(secret))
            rows.append((key, text))
            whole[key] = form, text.replace(secret, "<SECRET>")
    for form, make in PLAIN.items():
        for _ in range(EACH):
            key, text = len(rows), around(make())
            rows.append((key, text))
            whole[key] = form, text
    found = {x["doc_id"]: x["text"] for x in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = {}
    for key, (form, text) in whole.items():
        right.setdefault(form, []).append(found[key] == text)
    shares = {form: sum(x) / len(x) for form, x in right.items()}
    assert min(shares.values()) >= 0.9, shares


def test_both_sides_and_the_path_count(spark):
    """Of one token, what stands after it and the path of its document are features as well."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.array(*secret_scan.features(F.lit("a" * 20), F.lit("x"), F.lit(" sha256 token"), F.lit("test/a"))).alias("x")).first()["x"]
    by = dict(zip(secret_scan.FEATURES, row, strict=True))
    assert by["secret_after"] == by["plain_after"] == by["closed"] == by["test_path"] == 1 and by["secret_word"] == 0


def plain(text, before, after, path, words):
    """FEATURES by loops over characters and parts."""
    import re

    def kind(c):
        return next((k for k, of in (("a", string.ascii_lowercase), ("A", string.ascii_uppercase), ("0", string.digits)) if c in of), "-")

    def unrepeated(of):
        return sum(i == 0 or of[i] != of[i - 1] for i in range(len(of)))

    low, i, covered = text.lower(), 0, 0
    while i < len(low):
        longest = max((len(w) for w in secret_scan.DICTIONARY if low.startswith(w, i)), default=0)
        covered, i = covered + longest, i + max(1, longest)
    parts, part = [], ""
    for c in text:
        k = kind(c)
        if k not in "aA" or (part and k == "A" and part[-1].islower()):
            parts.append(part)
            part = ""
        if k in "aA":
            if len(part) > 1 and k == "a" and part.isupper():
                parts.append(part)
                part = ""
            part += c
    parts.append(part)
    n, changes = len(text), unrepeated([kind(c) for c in text]) - 1
    has = lambda pattern, of: float(bool(re.search(pattern, of)))
    hexes = all(c in "0123456789abcdef" for c in text) or all(c in "0123456789ABCDEF" for c in text)
    return [
        min(n, 200), changes, changes / n, covered / n, sum(c in string.digits for c in text) / n, float(hexes), text.count("/"), float(before[-1:] in tuple("/.@~")),
        has(secret_scan.SECRET_WORDS, before), has(secret_scan.PLAIN_WORDS, before), has(r"[=:]>?[^A-Za-z0-9_]{0,6}$", before), has(f"^({secret_scan.KNOWN})", text),
        float(text.startswith("-----BEGIN")), has("(?i)(test|example|fixture|mock|sample)", path), unrepeated(text) / n, has(r"://[^\s/:@\"'`<>]*:$", before), has(secret_scan.SECRET_WORDS, after),
        has(secret_scan.PLAIN_WORDS, after), float(not after or after[0] in " \t\n\"'`@"), sum(len(p) for p in parts if p.lower() in words) / n,
    ]


def test_features_are_those_of_plain_loops(spark):
    from pyspark.sql import functions as F

    words = ("thing", "uni", "ordinary", "est", "tone", "made")
    findings = secret_scan.labelled_findings(400, seed=8)
    for i, text in enumerate(("madeThing-ToneTONEtone9", "ordinary_made_thing_12345", "UniThingTONE0", "x")):
        findings.append(findings[i] | {"text": text})
    rows = secret_scan.findings_table(spark, findings)
    x = F.array(*secret_scan.features(F.col("text"), F.col("before"), F.col("after"), F.col("path"), words=words))
    for row in rows.select("text", "before", "after", "path", x.alias("x")).collect():
        assert row["x"][:-1] == pytest.approx(plain(row["text"], row["before"], row["after"], row["path"], words)), row


def test_every_secret_is_a_candidate_at_its_place(spark):
    """With a forest that takes all candidates, findings are those that were planted: no other text, no part of one."""
    rows, planted = [], {}
    for form, make in SECRETS.items():
        if form == "ruby":
            continue
        frame, secret = make()
        text = around(frame.format(secret))
        planted[len(rows)] = [(text.index(secret), len(secret))]
        rows.append((len(rows), text))
    several = "the password is aB3dE5gH7j, <token>zY9xW8vU7t</token> --secret qP0oI9uY8t -u me:hJ6kL5mN4b x"
    planted[len(rows)] = [(several.index(s), 10) for s in ("aB3dE5gH7j", "zY9xW8vU7t", "qP0oI9uY8t", "hJ6kL5mN4b")]
    rows.append((len(rows), several))
    harmless = "the password is understanding; <b>token</b> and <secret/> --verbose understanding -understanding -u me you"
    planted[len(rows)] = []
    rows += [(len(rows), harmless), (len(rows) + 1, ""), (len(rows) + 2, None)]
    found = {}
    for x in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string"), forest=[1.0]).collect():
        found.setdefault(x["doc_id"], []).append((x["start"], x["length"]))
    assert found == {k: v for k, v in planted.items() if v}


def test_frequent_words_are_counted_once_a_document(spark):
    texts = ["we met a long river, and river again"] * 12 + ["they saw some house here"] * 9 + ["password: abcdefgh is xyz=plainword and key-word now"] * 20 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert secret_scan.frequent_words(docs) == ("long", "river")
    assert secret_scan.frequent_words(docs, least=9) == ("long", "river", "house", "some")
    assert secret_scan.frequent_words(docs, n=1) == ("long",)
    assert secret_scan.frequent_words(docs.where("false")) == ()


def walked(forest, x):
    total = 0.0
    for node in forest:
        while not isinstance(node, float):
            f, t, low, high = node
            node = low if x[f] <= t else high
        total += node
    return total / len(forest)


def test_vote_is_the_mean_of_the_trees(spark):
    from pyspark.sql import functions as F

    forest = secret_scan.default_forest(spark)
    rows = secret_scan.findings_table(spark, secret_scan.labelled_findings(300, seed=3))
    x = F.array(*secret_scan.features(F.col("text"), F.col("before"), F.col("after"), F.col("path")))
    for row in rows.select(x.alias("x"), secret_scan.vote(forest, x).alias("p")).collect():
        assert row["p"] == pytest.approx(walked(forest, row["x"]))
