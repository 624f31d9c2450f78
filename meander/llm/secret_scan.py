"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

A text is split at its candidates, so each has its left and right neighbourhood at hand within the row, and nothing is
shuffled but counts of words. Features of a candidate are its length, the changes between character classes, the shares that
a list of words and the documents' own frequent words cover, its path-like parts, the path of its document, and the words to
its left and right. The forest is trained in numpy on labelled findings (a bounded fixture made by rules below, or a table of
one's own) whose features the same expressions give, and is then a walk over constant arrays of its nodes.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9+/_-]"
KEY = "PRIVATE KEY(?: BLOCK)?-----"
#: A key block from BEGIN to END with all between; without an END, its header and body lines.
BLOCK = rf"-----BEGIN [A-Z0-9 ]*?{KEY}(?:[\s\S]*?-----END [A-Z0-9 ]*?{KEY}|(?:\s*+[A-Za-z-]++: [^\n]*+\n)*+[A-Za-z0-9+/=\s]*+)"
#: What stands before a value that is assigned to a name ending in a secret word, before a URL's password, and before a
#: bearer's token. It is a part of the match and is taken off again (LEAD), so that there may be any blanks between.
NAMES = "token|secret|passwd|password|passphrase|pwd|credential|bearer|(?:api|auth|access|private|secret|signing|encryption)[_ -]?key"
#: From the end of such a name to the value; what a name is is looked up only where a sign of assignment follows.
SIGN = r"[\"']?[ \t]*+:?[=:]>?[ \t]*+[\"']?"
NAME = rf"(?=[\"']?[ \t]*+[=:])(?<=(?i:{NAMES})s?){SIGN}"
URL = r"://[^\s/:@\"'`<>]*+:"
BEARER = r"[Bb](?i:earer|asic)[ \t]++"
ASSIGNED = r"[^\s\"'`<>,;=:][^\s\"'`<>,;]{7,}+"
#: Values that an element or its attribute holds, that follow an option or a user on a command line, or that a sentence states.
ELEMENT = r"[\"']?(?:[ \t]++value[ \t]*+=[ \t]*+[\"']|[ \t]*+>)"
OPTION = r"--?(?=[A-Za-z])[A-Za-z0-9_-]*+[ \t]++[\"']?"
USER = r"(?:-u|--user)[ \t=]++[\"']?[^\s:\"'/=]++:(?!/)"
STATED = r"[ \t]++(?:is|was)(?:[ \t]*+:)?[ \t]++[\"'`]?"
#: A stated value has a digit, or a capital letter after a small one: without either it is a word of the sentence.
MIXED = r"(?=[^\s\"'`<>,;=:]*?(?:[0-9]|[a-z][A-Z]))"
LEAD = rf"^(?:{URL}|{USER}|{OPTION}|{STATED}|{SIGN}|{ELEMENT}|{BEARER})"
#: These forms with their values; a name is looked up only where the form goes on behind it.
FORMS = (
    rf"(?=[\"']?[ \t]*+(?:>|value[ \t=]))(?<=(?i:{NAMES})s?){ELEMENT}{ASSIGNED}(?=</|[\"'])"
    rf"|(?<!\S)(?:{USER}|(?=--?[A-Za-z0-9_-]*+(?<=(?i:{NAMES})s?)[ \t]){OPTION}){ASSIGNED}"
    rf"|(?=[ \t]++(?:is|was)[ \t:])(?<=(?i:{NAMES})s?){STATED}{MIXED}{ASSIGNED}"
)
#: Known kinds, with or without digits; a JWT with its dots.
KNOWN = r"eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]+)+|A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{8,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
#: Any of these, a run of 16 and more token characters with a digit among them, or one of 20 and more in which small and
#: capital letters change places twice.
CANDIDATE = rf"{BLOCK}|{NAME}(?:{BLOCK}|{ASSIGNED})|{FORMS}|{URL}[^\s/@\"'`<>]++(?=@)|{BEARER}{TOKEN}{{8,}}+={{0,2}}|(?<!{TOKEN})(?:{KNOWN}|(?=[A-Za-z+/_-]*+[0-9]){TOKEN}{{16,}}+={{0,2}}|(?=(?:[A-Z+/_-]*+[a-z+/_-]++[A-Z]){{2}}){TOKEN}{{20,}}+={{0,2}})"
BEFORE, AFTER = 40, 24
TREES, DEPTH, LEAF, SEED, FINDINGS = 25, 8, 4, 11, 7200
THRESHOLD = 0.5
MASK = "<SECRET>"

#: Of the documents' words, the most frequent are a dictionary too: at most WORDS of them, each in LEAST documents or more.
WORDS, LEAST = 2000, 10
#: A word between words of a sentence: no value, name or part of an identifier.
WORD = "(?<=[a-z,;] )[a-z]{4,12}(?=[ ,;.\n])"
#: Words that cover identifiers, paths and placeholders, also within other words and in whatever language the documents are.
DICTIONARY = (
    "access", "account", "action", "address", "admin", "archive", "array", "asset", "author", "backup", "base", "binary", "block", "branch", "buffer", "build", "button", "cache", "change",
    "changeme", "channel", "check", "class", "client", "cloud", "code", "column", "common", "component", "config", "connection", "content", "context", "control", "cookie", "count", "create",
    "custom", "data", "date", "debug", "default", "delete", "demo", "design", "device", "display", "document", "domain", "download", "dummy", "editor", "element", "email", "enable", "engine",
    "entity", "entry", "error", "event", "example", "export", "field", "file", "filter", "final", "folder", "format", "frame", "function", "global", "group", "handle", "header", "height",
    "home", "host", "image", "import", "index", "info", "input", "insert", "install", "instance", "interface", "item", "label", "language", "layout", "level", "library", "license", "list",
    "load", "local", "location", "login", "manager", "master", "match", "media", "member", "memory", "menu", "message", "method", "model", "module", "name", "network", "node", "number",
    "object", "option", "order", "output", "package", "page", "panel", "parameter", "parent", "path", "pattern", "placeholder", "player", "plugin", "point", "position", "print", "process",
    "product", "profile", "project", "property", "public", "python", "query", "random", "range", "record", "region", "register", "release", "remote", "report", "request", "resource",
    "response", "result", "sample", "schema", "screen", "script", "search", "section", "select", "server", "service", "session", "setting", "size", "source", "start", "state", "static",
    "status", "string", "style", "system", "table", "target", "task", "temp", "test", "text", "theme", "thread", "time", "title", "type", "update", "user", "value", "version", "view",
    "window", "word", "xxxx", "your",
)
SECRET_WORDS = r"(?i)(?<![a-z])(token|secret|passwd|password|passphrase|api|auth|bearer|credential|private|access|key|pwd)s?(?![a-z])"
PLAIN_WORDS = r"(?i)(?<![a-z])(sha|commit|hash|md|uuid|guid|digest|checksum|revision|etag|card|phone|isbn|build|serial|order|invoice|https?|www|id)(?![a-z])"
FEATURES = (
    "length", "transitions", "transition_share", "dictionary", "digits", "hexadecimal", "slashes", "after_slash", "secret_word", "plain_word", "assigned", "prefix", "block", "test_path", "repeated",
    "url_password", "secret_after", "plain_after", "closed", "frequent", "named",
)


def frequent_words(docs: DataFrame, text: str = "text", n: int = WORDS, least: int = LEAST) -> tuple[str, ...]:
    """The n words that most documents have, of those that at least `least` have; ties go to the smaller word.

    Words are counted over all whole texts, once a document, and before the shuffle; n words at most come to the driver.
    Null and empty texts and empty tables have none; a repeated row counts each time.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(docs[text], F.lit(WORD), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return tuple(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(n).collect())


def features(text: Column, before: Column, after: Column, path: Column, dictionary: tuple[str, ...] = DICTIONARY, words: tuple[str, ...] = ()) -> list[Column]:
    """FEATURES of a candidate, as doubles. Words of `dictionary` count anywhere, those of `words` as whole parts of a name."""
    size = F.char_length(text)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    covered = size - F.char_length(F.regexp_replace(F.lower(text), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), ""))
    parts = F.transform(F.regexp_extract_all(text, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower)
    known = F.aggregate(F.filter(parts, lambda w: w.isin(*words)), F.lit(0), lambda n, w: n + F.char_length(w)) if words else F.lit(0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    found = [
        F.least(size, F.lit(200)), changes, changes / size, covered / size, F.char_length(F.regexp_replace(text, "[^0-9]", "")) / size,
        flag(text.rlike("^([0-9a-f]+|[0-9A-F]+)$")), F.char_length(F.regexp_replace(text, "[^/]", "")), flag(before.rlike(r"[/.@~]$")),
        flag(before.rlike(SECRET_WORDS)), flag(before.rlike(PLAIN_WORDS)), flag(before.rlike(r"[=:]>?\W{0,6}$")),
        flag(text.rlike(f"^({KNOWN})")), flag(text.startswith("-----BEGIN")),
        flag(path.rlike("(?i)(test|example|fixture|mock|sample)")), F.char_length(F.regexp_replace(text, r"(?s)(.)\1+", "$1")) / size,
        flag(before.rlike(f"{URL}$")), flag(after.rlike(SECRET_WORDS)), flag(after.rlike(PLAIN_WORDS)), flag(after.rlike(r"^([\s\"'`@]|$)")),
        known / size, flag(before.rlike(rf"(?i:{NAMES})s?(?:{SIGN}|{ELEMENT}|{STATED}|[ \t]++[\"']?)$|\s(?:{USER})$")),
    ]
    return [c.cast("double").alias(n) for n, c in zip(FEATURES, found, strict=True)]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[dict]:
    """Findings with label 1 (a secret) or 0, made by rules: random tokens in settings, URLs and headers against hashes,
    numbers, names, paths and placeholders in the same surroundings. Words are random letters, so no text is learned."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    one = lambda *options: options[rng.integers(len(options))]
    hexes, digits, full = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: pick("aeinorstlmdu", rng.integers(2, 9))
    name = lambda: one("token", "TOKEN", "secret", "api_key", "password", "auth_token", "access key", "private_key", "client_secret", "passwd", "Token", "API-KEY", "passphrase", "signing_key")
    names = lambda k: "_".join(one(*DICTIONARY) for _ in range(k))
    out = []
    for i in range(n):
        left = " ".join(word() for _ in range(4)) + one(" ", ". ", "\n", "; ", " - ", ", ")
        right = one('"', "'", "", '",', " #") + " " + word() + " " + word()
        path = one("", "", "", "src/main", "docs", "test/fixtures")
        def shown(value: str, left: str = left, right: str = right) -> tuple[str, str]:
            """What stands around a value that is an element's, an option's, or stated."""
            form, named = rng.integers(4), one(name(), word() + "_" + name()).replace(" ", "-")
            if form == 0:
                return one(left, word() + ">\n") + f"<{named}>", f"</{named}>" + word()
            if form == 1:
                return left + f'<add key="{named}" value="', '"/> ' + word()
            if form == 2:
                return left + word() + one(f" --{named} ", f" -{named} ", f" -u {word()}:", f" --user {word()}:", f" --{named} '"), one(" ", "'", "\n") + word()
            return left + one("the ", "my ", "our ", "") + named + one(" is ", " is: ", " was ", ' is "'), one(" ", ", ", ".", '"') + word()

        sign = one(" = ", "=", ": ", " := ", " => ", ":") + one('"', "'", "")
        if i % 2:
            kind = rng.integers(9)
            if kind == 0:  # known kinds, named or not
                text, left = one("AKIA" + pick(full[:26] + digits, 16), "ghp_" + pick(full, 36), "sk-" + pick(full, 40), "xoxb-" + pick(digits, 11) + "-" + pick(full, 24), "eyJ" + pick(full, 20) + "." + pick(full + "_-", 40) + "." + pick(full + "_-", 43), "AIza" + pick(full, 35)), one(left, word() + " ", left + one("id ", "id: ", "serial "), left + name() + sign)
            elif kind == 1:  # passwords, short or of letters alone
                text = one(pick(full, rng.integers(8, 16)), pick(full[:52], rng.integers(8, 30)), pick(full + "!@#$%^&*", rng.integers(8, 16)), pick(full[26:52], rng.integers(8, 24)), one(*DICTIONARY).title() + pick(digits, rng.integers(2, 5)) + one("!", "#", "$"))
                left += name() + sign
            elif kind == 2:  # key blocks
                of, head = one(("RSA ", ""), ("", ""), ("OPENSSH ", ""), ("EC ", ""), ("RSA ", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + pick(hexes.upper(), 32) + "\n\n"), ("PGP ", "Version: GnuPG v2\n\n"))
                kind_of = of + "PRIVATE KEY" + (" BLOCK" if of == "PGP " else "")
                text, left, right = f"-----BEGIN {kind_of}-----\n" + head + pick(one(full, full[:26] + full[:26] + full), one(17, 200, 300, 900)) * one(1, 5, 20) + f"\n-----END {kind_of}-----", one(left, word() + "\n", word() + " ", "", left + name() + sign), one("\n", " ", "")
            elif kind == 3:  # passwords in URLs
                text = one(pick(full, rng.integers(6, 24)), pick(full[26:52], rng.integers(6, 14)) + pick(digits, rng.integers(0, 4)), pick(full + "!$%^&*", rng.integers(6, 16)))
                left, right = left + one("postgres", "mysql", "https", "amqp", "redis", "mongodb+srv") + "://" + one(word(), "", "admin", "root") + ":", "@" + word() + one(".com", "", ":5432") + "/" + word()
            elif kind == 4:  # headers, with or without the name
                text, left = pick(full + "_-", rng.integers(20, 60)), left + one("Authorization: Bearer ", "bearer ", "Authorization: Basic ", "-H 'X-Api-Key: ", "Bearer ")
            elif kind == 5:  # passwords and tokens in elements, on command lines and in sentences
                text = one(pick(full, rng.integers(8, 16)), word() + pick(digits, rng.integers(1, 4)) + pick(full, 5) + one("", "!", "&"), pick(full + "!@#$%^&*", rng.integers(8, 16)), pick(full, rng.integers(16, 44)), pick(hexes, one(16, 32, 40)))
                left, right = shown(text)
            else:  # assigned random tokens
                text = one(pick(hexes, one(32, 40, 64)), pick(hexes, rng.integers(10, 65)), pick(hexes, 40).upper(), pick(full, rng.integers(16, 64)), pick(full + "+/", 43) + "=", pick(full + "_-", rng.integers(24, 48)), pick(full[:52], rng.integers(20, 40)))
                left += one(name(), word() + "_" + name()) + one(sign, sign, " ", " is ")
        else:
            kind = rng.integers(11)
            if kind == 10:  # names, places and versions in elements, on command lines and in sentences
                text = one(names(2) + pick(digits, 1), names(2).upper() + pick(digits, 1), "${" + names(2).upper() + "}", "$" + names(2).upper(), one(*DICTIONARY) + one(*DICTIONARY).title() + one(*DICTIONARY).title(), "v" + ".".join(pick(digits, 2) for _ in range(3)), "-".join((pick(digits, 4), pick(digits, 2), pick(digits, 2))), one(*DICTIONARY) + "-" + one(*DICTIONARY) + "-" + pick(digits, 1), "/" + one(*DICTIONARY) + "/" + one(*DICTIONARY) + pick(digits, 2), one(*DICTIONARY).ljust(8, "s") + pick(digits, 1), "your-" + one(*DICTIONARY) + pick(digits, 1), pick(digits, 4) + ":" + pick(digits, 4), (word() + word()).ljust(8, "e"), (word() + word()).title().ljust(8, "e"))
                left, right = shown(text)
            elif kind == 0:  # card and account numbers
                text = pick(digits, rng.integers(16, 20))
                left += one("", "card ", "order ", "")
            elif kind == 1:
                text = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
                left += one("uuid ", "id: ", "", "guid=", "request_id = ")
            elif kind == 2:  # digests, named before or after
                text = pick(hexes, one(32, 40, 64))
                left, right = one((left + one("commit ", "sha1: ", "md5 = ", "checksum ", "revision ", "etag: ", "digest="), right), (left, one(" sha256 ", " (commit) ", "  checksum of ", " md5 ") + word()), (left, right))
            elif kind == 3:
                text = names(3) + "_" + pick(digits, rng.integers(1, 5))
                left += one("", "key = ", "token: ", "")
            elif kind == 4:
                text = "/".join([one(*DICTIONARY), one(*DICTIONARY), word() + pick(digits, 2), word()]).ljust(16, "a")
                left += one("/", "https://", "path: ", "~", "secret: /")
            elif kind == 5:
                text = one("x" * 20 + pick(digits, 4), "0" * 24, "1234567890123456", "EXAMPLE" + pick(digits, 12), "your-token-here-123", "changeme1234567890")
                left += one("token = ", "password: ", "api_key=", "") + one('"', "")
            elif kind == 6:
                text = (word() + word() + word() + pick(digits, rng.integers(1, 4)) + word()).ljust(16, "e")
            elif kind == 7:
                text = "=" * rng.integers(16, 60) + pick(digits, 1)
            elif kind == 8:  # names and placeholders where a secret would be
                text = one(names(rng.integers(2, 4)), "x" * int(rng.integers(8, 24)), "*" * int(rng.integers(8, 16)), "your" + one("-", "_", "") + one(*DICTIONARY), "${" + names(2).upper() + "}", "changeme" + pick(digits, rng.integers(0, 3)), "example-" + one(*DICTIONARY), "/".join(["", one(*DICTIONARY), one(*DICTIONARY)]), "".join(one(*DICTIONARY).title() for _ in range(3)) + one("()", ""), one(*DICTIONARY) + "." + one(*DICTIONARY) + "." + one(*DICTIONARY))
                left += name() + sign
            else:  # names in mixed letters
                text = (one(*DICTIONARY) + "".join(one(*DICTIONARY).title() for _ in range(3))).ljust(20, "s")
                left += one("", one(*DICTIONARY) + ".", "class ", name() + sign)
        out.append({"text": text, "before": left[-BEFORE:], "after": right[:AFTER], "path": path, "label": i % 2})
    return out


def findings_table(spark: SparkSession, findings: list[dict]) -> DataFrame:
    """A bounded list of labelled findings as a table, from one literal."""
    rows = F.from_json(F.lit(json.dumps(findings)), "array<struct<text:string,before:string,after:string,path:string,label:int>>")
    return spark.range(1).select(F.inline(rows))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree: (feature, threshold, below or equal, above), or the share of label 1."""
    share = float(y.mean())
    if not depth or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], max(1, int(round(x.shape[1] ** 0.5)) + 1), replace=False):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:])[:: max(1, len(values) // 16)] / 2:
            low = x[:, f] <= t
            n = int(low.sum())
            if LEAF <= n <= len(y) - LEAF:
                a, b = y[low].mean(), y[~low].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = impurity, int(f), float(t), low
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A random forest: each tree on a bootstrap sample, each split on a random choice of features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng, depth))
    return out


def vote(forest: list, row: Column) -> Column:
    """The forest's probability for an array of features.

    Nodes of all trees are numbered in constant arrays, and a step goes from a node to one below it; a leaf stays where it
    is. So the expression is as small for a large forest as for a small one.
    """
    nodes: list[tuple] = []

    def number(node) -> int:
        at = len(nodes)
        nodes.append(())
        if isinstance(node, float):
            nodes[at] = (0, 0.0, at, at, node)
        else:
            f, t, low, high = node
            nodes[at] = (f, t, number(low), number(high), 0.0)
        return at

    def depth(node) -> int:
        return 0 if isinstance(node, float) else 1 + max(depth(node[2]), depth(node[3]))

    roots = [number(t) for t in forest]
    fixed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    f, t, low, high, value = (fixed(c, k) for c, k in zip(zip(*nodes, strict=True), ("int", "double", "int", "int", "double"), strict=True))
    steps = F.sequence(F.lit(1), F.lit(max(1, *map(depth, forest), 1)))

    def leaf(root: Column) -> Column:
        return F.aggregate(steps, root, lambda n, _: F.when(F.get(row, F.get(f, n)) <= F.get(t, n), F.get(low, n)).otherwise(F.get(high, n)))

    return F.aggregate(fixed(roots, "int"), F.lit(0.0), lambda total, root: total + F.get(value, leaf(root))) / len(forest)


_forests: dict[tuple[str, ...], list] = {}


def train(findings: DataFrame, words: tuple[str, ...] = ()) -> list:
    """A forest from labelled findings: text, before, after, path, label. The table is a bounded training set: the driver reads it."""
    rows = findings.select(*features(F.col("text"), F.col("before"), F.col("after"), F.coalesce(F.col("path"), F.lit("")), words=words), F.col("label").cast("int").alias("label")).collect()
    table = np.array([tuple(r) for r in rows], np.float64)
    table = table[np.lexsort(table.T)]
    return fit(table[:, :-1], table[:, -1])


def default_forest(spark: SparkSession, words: tuple[str, ...] = ()) -> list:
    if words not in _forests:
        _forests.clear()
        _forests[words] = train(findings_table(spark, _default_findings()), words)
    return _forests[words]


@lru_cache
def _default_findings() -> list[dict]:
    return labelled_findings()


PARTS, FOUND, SCORED, LEADS = "__secret_parts", "__secret_found", "__secret_scored", "__secret_leads"


def scored(docs: DataFrame, text: str = "text", path: str | None = None, forest: list | None = None, words: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with PARTS (what lies between candidates), FOUND (candidates) and SCORED (their probabilities).

    Where no `words` are given they are counted in the documents (`frequent_words`); a forest of one's own has been trained
    with the words that are given here. Null and empty texts have no candidates and come through unchanged; a null path is empty; texts of any length are
    searched whole.
    """
    if words is None:
        words = () if forest else frequent_words(docs, text)
    forest = forest or default_forest(docs.sparkSession, words)
    where = F.coalesce(docs[path].cast("string"), F.lit("")) if path else F.lit("")
    whole = F.coalesce(F.regexp_extract_all(docs[text], F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>"))
    out = docs.withColumn(FOUND, whole)
    out = out.withColumn(LEADS, F.transform(FOUND, lambda m: F.regexp_extract(m, LEAD, 0)))
    # What names a value goes to the part before it.
    parts = F.zip_with(F.split(F.col(text), CANDIDATE, -1), LEADS, lambda p, named: F.concat(p, F.coalesce(named, F.lit(""))))
    values = F.zip_with(FOUND, LEADS, lambda m, named: F.substr(m, F.char_length(named) + 1))
    out = out.withColumns({PARTS: F.when(F.size(FOUND) > 0, parts), FOUND: values})
    near = F.transform(FOUND, lambda m, i: F.array(*features(m, F.right(F.get(F.col(PARTS), i), F.lit(BEFORE)), F.left(F.get(F.col(PARTS), i + 1), F.lit(AFTER)), where, words=words)))
    return out.withColumn(SCORED, F.transform(near, lambda x: vote(forest, x)))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, forest: list | None = None) -> DataFrame:
    """One row per secret: key, ordinal among the row's candidates, start and length in code points, score, secret_sha256.

    The secret itself is not given. Repeated rows give repeated findings; null and empty texts and empty tables give none.
    Further columns, whatever their names, are not read.
    """
    some = scored(docs.select(*dict.fromkeys([key, text, *([path] if path else [])])), text, path, forest)
    # A candidate starts after all parts and candidates before it; each part is measured with the candidate that follows it.
    sizes = F.zip_with(PARTS, FOUND, lambda p, m: F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0)))
    ends = F.aggregate(sizes, F.array().cast("array<long>"), lambda at, n: F.concat(at, F.array(F.coalesce(F.element_at(F.when(F.size(at) > 0, at), -1), F.lit(0).cast("long")) + n)))
    each = some.select(key, FOUND, SCORED, F.when(F.size(FOUND) > 0, ends).alias("__secret_ends"))
    found = F.transform(FOUND, lambda m, i: F.struct(i.alias("ordinal"), (F.get("__secret_ends", i) - F.char_length(m)).alias("start"), F.char_length(m).cast("long").alias("length"), F.round(F.get(SCORED, i), 6).alias("score"), F.sha2(m, 256).alias("secret_sha256")))
    # Candidates are rows before any is left out: a filter on their scores that went below would make the search run twice.
    return each.select(key, F.inline(found)).where(F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, text: str = "text", path: str | None = None, forest: list | None = None, mask: str = MASK) -> DataFrame:
    """The same rows and columns with every secret replaced by `mask`; n_chars, where there is one, follows a changed text."""
    some = scored(docs, text, path, forest)
    hit = F.exists(SCORED, lambda s: s >= THRESHOLD)
    joined = F.concat(F.array_join(F.transform(FOUND, lambda m, i: F.concat(F.get(F.col(PARTS), i), F.when(F.get(F.col(SCORED), i) >= THRESHOLD, F.lit(mask)).otherwise(m))), ""), F.element_at(PARTS, -1))
    new = {text: F.when(hit, joined).otherwise(docs[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(joined).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return some.withColumns(new).select(*docs.columns)
