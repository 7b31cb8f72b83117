r"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates, wide on purpose: private-key blocks, three-part signed tokens, passwords within URLs, values of VALUE_MIN
characters or more that are assigned to a name with a secret word in it, and any other run of RUN_MIN or more characters of
[A-Za-z0-9+/_-] (with up to two = at its end).  Their features: length and character classes, transitions (changes of class; how usual
pairs of letters are in words), share of the letters that dictionary words cover, the path, the words next to it.  The
dictionary is taken from vocabulary files, whose paths are a parameter: their whole words, in
the languages that they have; pair frequencies are counted over it.

The forest is trained from labelled findings; the caller gives them, or takes `example_findings`, a generated set of bounded
size (EXAMPLES rows, the documented limit of the fit) in the shapes of public formats and of what is mistaken for them.  Every candidate of every
text is scored.

Null and empty texts have no candidates; long ones are read whole.  Repeated rows give repeated findings, ties keep the order of the text.  A null path counts as empty; an empty table has none.
The candidates themselves are returned only as SHA-256 with their span (code points).  Other columns stay as they are; those
named like a result (start, end, value_sha256, probability, is_secret) are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

EXAMPLES = 6000
RUN_MIN, VALUE_MIN = 16, 6
AROUND = 48
WORD_MIN = 4

# Words in names of secrets, words next to what only looks like one, and what stands for a value.
SECRET_WORDS = "token secret password passwd passphrase passwort pwd auth kennwort contraseña clave motdepasse key apikey auth bearer credential credentials private access signature".split()
HARMLESS_WORDS = frozenset("sha sha1 sha256 sha512 md5 checksum digest commit hash etag uuid guid id revision build version example sample dummy placeholder integrity class href src base64 image png data public fingerprint thumbprint".split())
PLACEHOLDERS = frozenset("your my the changeme change example sample dummy placeholder replace insert todo none null true false undefined xxx redacted required optional secret password token here enter value string test foo bar".split())
TEST_PATH = re.compile(r"test|example|sample|mock|fixture|doc", re.I)

_WORD = re.compile("|".join(SECRET_WORDS))
_ASSIGNED = re.compile(r"[\w-]{0,30}[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}(?:(?i:bearer|basic)\s+)?(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|([^\s\"'<>,;(){}\[\]]{%d,}))" % ((VALUE_MIN,) * 3))
_BEFORE = re.compile(r"[\w.-]{0,30}\Z")
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % RUN_MIN)
#: what begins with a fixed text: the candidate is the group
_FIXED = [
    ("-----BEGIN ", re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----)")),
    ("eyJ", re.compile(r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("://", re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{4,})@")),
]
FEATURES = [
    "length", "digit_share", "upper_share", "other_share", "class_changes", "distinct_share", "transition", "vowel_share", "dictionary_share", "longest_letters", "placeholder", "assigned", "quoted", "secret_word", "harmless_word", "test_path", "hex", "uuid", "blanks", "reference", "parts", "public_prefix"
]
# How public services begin their keys.
PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abp]-|sk_live_|rk_live_|sk-|AIza|glpat-|npm_|pypi-|SG\.|hf_|shpat_|dop_v1_|eyJ|-----BEGIN)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_REFERENCE = re.compile(r"^[$%<{]|^(?:os|process|env|config|settings|self|this|request|getenv|System)\b[.\[(]|\$\{|\{\{|^\*+$|\(\)|^(.)\1*$")
_LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_models: dict[tuple, Words] = {}


class Words:
    """Whole words of vocabulary files, and how usual pairs of letters are in them."""

    def __init__(self, paths: tuple[str, ...]):
        self.words: set[str] = set()
        for path in paths:
            with open(path, "rb") as f:
                for line in f:
                    try:
                        word = base64.b64decode(line.split(b" ")[0], validate=True).decode()
                    except ValueError:
                        continue
                    if word[:1] == " " and word[1:].isalpha() and len(word) > WORD_MIN:
                        self.words.add(word[1:].lower())
        self.longest = max(map(len, self.words), default=0)
        pairs: dict[str, int] = {}
        for w in self.words:
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] = pairs.get(w[i : i + 2], 0) + 1
        total = sum(pairs.values()) or 1
        self.rare = math.log(0.5 / total)
        self.pairs = {k: math.log(v / total) for k, v in pairs.items()}

    def covered(self, letters: str) -> int:
        """The most letters of a run that words which don't overlap cover."""
        best = [0] * (len(letters) + 1)
        for i in range(1, len(letters) + 1):
            best[i] = best[i - 1]
            for n in range(WORD_MIN, min(i, self.longest) + 1):
                if best[i - n] + n > best[i] and letters[i - n : i] in self.words:
                    best[i] = best[i - n] + n
        return best[-1]


def words_of(paths: tuple[str, ...]) -> Words:
    if paths not in _models:
        _models[paths] = Words(paths)
    return _models[paths]


def features(value: str, before: str, after: str, path: str, words: Words) -> list[float]:
    size = len(value)
    body = value.rstrip("=")
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in body]
    n = len(body) or 1
    runs = [r.lower() for r in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", body))]
    letters = sum(map(len, runs))
    pairs = [words.pairs.get(r[i : i + 2], words.rare) for r in runs for i in range(len(r) - 1)]
    near = re.findall(r"[^\W_]+", before.lower())[-4:]
    name = re.search(r"([\w.-]+)[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}(?:(?:bearer|basic)\s+)?[\"']?$", before, re.I)
    said = (name[1] if name else " ".join(near[-2:])).lower()
    return [
        math.log(size + 1), kind.count("d") / n, kind.count("u") / n, kind.count("o") / n, sum(a != b for a, b in zip(kind, kind[1:])) / n, len(set(body)) / min(n, 64),
        sum(pairs) / len(pairs) if pairs else 0.0, sum(c in "aeiouáéíóúàèäöü" for r in runs for c in r) / (letters or 1), sum(map(words.covered, runs)) / (letters or 1), float(max(map(len, runs), default=0)),
        float(any(r in PLACEHOLDERS for r in runs)), float(bool(name) or before.endswith("://") or bool(re.search(r"://[^\s/:@]+:$", before))), float(before[-1:] in ("'", '"') and before[-1:] == after[:1]),
        float(any(w in said for w in SECRET_WORDS)), float(any(w in HARMLESS_WORDS for w in near[-3:])), float(bool(TEST_PATH.search(path))), float(bool(re.fullmatch("[0-9a-fA-F]+", body))), float(bool(_UUID.fullmatch(body))),
        float(" " in body), float(bool(_REFERENCE.search(value))), float(len(re.split(r"[/_.\s-]+", body))), float(bool(PREFIX.match(value))),
    ]


def example_findings(rows: int = EXAMPLES, seed: int = 7, words: Words | None = None) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before, text after, path, label): made findings, half of them true, of public formats and common look-alikes."""
    r = random.Random(seed)
    known = sorted(words.words) if words and words.words else "value index table string config default service client server request response message content document language version number".split()
    word = lambda: r.choice(known)
    fill = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    alnum, low, url = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_"
    own, q3 = ["", "db_", "my", "app.", "user_", "client_", "X-", "prod_", "the "], ["'", '"', '"', ""]
    paths = ["src/app", "conf/prod", "lib/main", "web", ".env", "deploy.yml", "src" + str(r.randint(0, 30)), ""]

    def name() -> str:
        n = r.choice(own) + r.choice(SECRET_WORDS) + r.choice(["", "", "", "_key", "1", "_value"])
        return n.upper() if r.random() < 0.3 else n

    def password() -> str:
        base = word()[:9]
        base = r.choice([base, base.capitalize(), base.replace("o", "0").replace("e", "3").replace("a", "@"), word()[:4].capitalize() + word()[:5], some(low, 7)])
        return base + r.choice(["", r.choice("!?#$%&*-_")]) + str(r.randint(1, 9999)) + r.choice(["", r.choice("!?#$%&*")])

    out = []
    for i in range(rows):
        q, path = r.choice(q3), r.choice(paths)
        op = r.choice([" = ", ": ", "=", ":", " := ", '": ' if q == '"' else "="])
        before, after = f"{fill()} {name()}{op}{q}", q + r.choice(["\n", " ", ", ", ";"]) + fill()
        if i % 2 == 0:
            shape = r.randint(0, 11)
            k = r.choice([16, 20, 24, 32, 40, 40, 44, 64])
            raw = r.randbytes(k)
            if shape <= 2:
                value = r.choice([raw.hex()[:k], raw.hex()[:k], raw.hex()[:k].upper()])
            elif shape == 3:
                value = r.choice([base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("=")])
            elif shape == 4:
                value = some(r.choice([alnum, low, url]), k)
            elif shape in (5, 6):
                value = password()
                if shape == 6:
                    before, after = f"{fill()} {r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv'])}://{word()[:8]}:", f"@{word()}.{r.choice(['com', 'local', 'net'])}/{word()}"
            elif shape == 7:  # formats that need no name
                value = r.choice(["AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24), "sk_live_" + some(alnum, 24), "AIza" + some(url, 35), "glpat-" + some(url, 20), "npm_" + some(alnum, 36)])
                if r.random() < 0.6:
                    before, after = fill() + r.choice([" ", ": ", "\n", " is "]), " " + fill()
            elif shape == 8:
                value = ".".join(["eyJ" + base64.urlsafe_b64encode(r.randbytes(r.randint(15, 40))).decode().rstrip("=") for _ in range(2)] + [some(url, 43)])
                if r.random() < 0.5:
                    before = fill() + " Authorization: Bearer "
            elif shape == 9:
                value = "-----BEGIN " + r.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----\n" + base64.encodebytes(r.randbytes(r.randint(150, 900))).decode() + "-----END PRIVATE KEY-----"
                before, after = fill() + r.choice(["\n", " key: ", ' = "']), "\n" + fill()
            elif shape == 10:
                value = some(low + string.ascii_uppercase + "!#$%&*+?@^", r.randint(10, 28))
            else:
                value = f"{some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-4{some('0123456789abcdef', 3)}-a{some('0123456789abcdef', 3)}-{some('0123456789abcdef', 12)}"
            out.append((value, before[-AROUND:], after[:AROUND], path, 1))
            continue
        shape, prose = r.randint(0, 13), (fill() + r.choice([" ", " = ", ": ", '"', "("]), r.choice([" ", '"', ")", ", "]) + fill())
        if shape <= 1:  # long words and words run together
            value = "".join(word() for _ in range(r.randint(2, 4)))
            value = value.capitalize() if r.random() < 0.3 else value
            before, after = prose
        elif shape == 2:  # words of syllables that no dictionary has
            value = "".join(r.choice("bcdfghlmnprstv") + r.choice(["a", "e", "i", "o", "u", "ou", "ei"]) + r.choice(["", "n", "r", "s", "st", "nd"]) for _ in range(r.randint(6, 10)))
            before, after = prose
        elif shape in (3, 4):  # digests and ids named as such
            value, before = r.choice([r.randbytes(r.choice([16, 20, 32])).hex(), base64.b64encode(r.randbytes(r.choice([32, 48]))).decode()]), f"{fill()} {r.choice(sorted(HARMLESS_WORDS))}{r.choice(['=', ': ', ' ', ':', '-'])}"
            after = " " + fill()
        elif shape == 5:
            value = f"{some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-4{some('0123456789abcdef', 3)}-b{some('0123456789abcdef', 3)}-{some('0123456789abcdef', 12)}"
            before, after = f"{fill()} {r.choice(['id', 'uuid', 'guid', 'user', 'session', 'trace'])}{r.choice(['=', ': ', ' '])}", " " + fill()
        elif shape in (6, 7):  # identifiers and paths
            parts = [word() for _ in range(r.randint(3, 6))]
            value = r.choice(["_", "/", "-"]).join(parts) if r.random() < 0.7 else "".join(p.capitalize() for p in parts)
            value = value.upper() if r.random() < 0.2 else value + r.choice(["", "", str(r.randint(1, 99))])
            before, after = prose
        elif shape in (8, 9):  # placeholders, references and talk after secret words
            value = r.choice(["x" * 20, "your_api_key_goes_here", "REPLACE_ME_WITH_TOKEN", "0" * 32, "changeme", "${SECRET_KEY}", "$DB_PASSWORD", "<password>", "{{ vault_token }}", "os.environ['TOKEN']", "process.env.API_KEY", "getenv(\"KEY\")", "********", "password", "None", "example-token", "my-secret-value", "insert_token_here", "self.password", "undefined"])
            value = value if r.random() < 0.6 else r.choice([word(), word() + " " + word(), "required " + word(), word() + "_" + word(), "settings." + word(), "request." + word() + "()", word() + "." + word()])
            value = value if len(value) >= VALUE_MIN else value + word()
        elif shape == 10:
            value = some(string.digits, r.randint(16, 22))
            before, after = prose
        elif shape == 11:  # inline data
            value, before = base64.b64encode(r.randbytes(r.randint(60, 250))).decode(), fill() + r.choice([" data:image/png;base64,", " integrity=\"sha512-", " public key: "])
        elif shape == 12:  # parts of addresses
            value = "/".join([word(), word(), str(r.randint(1900, 2030)), word() + "-" + word() + "-" + word()])
            before, after = fill() + " https://" + word() + ".org/", " " + fill()
        else:
            value = r.choice(["-" * 24, "_" * 20, "=" * 16 + "A" * 4, "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghij", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345", "+" * 18])
            before, after = prose
        out.append((value, before[-AROUND:], after[:AROUND], r.choice([*paths, "tests/data", "docs/example"]), 0))
    return out


def found(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order; of those that overlap the first to begin, names of values among them, then the more specific."""
    events = [(m.start(), 4, *m.span()) for m in _RUN.finditer(text)]
    for rank, (begin, pattern) in enumerate(_FIXED):
        at = text.find(begin)
        while at >= 0:
            if m := pattern.match(text, at):
                events.append((at, rank, *m.span(1)))
            at = text.find(begin, at + 1)
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small letters
        low = text.translate(_LOW)
    for w in _WORD.finditer(low):
        if m := _ASSIGNED.match(text, w.start()):
            name = _BEFORE.search(text, max(0, w.start() - 30), w.start())
            events.append((name.start(), 3, *m.span(m.lastindex)))
    out, end = [], 0
    for at, _, a, b in sorted(events):
        if at >= end:
            out.append((a, b))
            end = b
    return out


_ROW = "start long, end long, value_sha256 string, " + ", ".join(f"{f} double" for f in FEATURES)
_NAMES = ("start", "end", "value_sha256", "probability", "is_secret")


def _candidate_rows(batches, paths):
    words = words_of(paths)
    for batch in batches:
        at, cols = [], [[] for _ in range(3 + len(FEATURES))]
        for i, (text, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for a, b in found(text or ""):
                at.append(i)
                v = [a, b, hashlib.sha256(text[a:b].encode()).hexdigest(), *features(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], p, words)]
                for c, x in zip(cols, v, strict=True):
                    c.append(x)
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * len(FEATURES)]
        names = ["row", "start", "end", "value_sha256", *FEATURES]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)


def _rest(docs: DataFrame, text_col: str) -> list[str]:
    return [c for c in docs.columns if c != text_col and c not in _NAMES]


def candidates(docs: DataFrame, vocabularies: tuple[str, ...], text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per candidate: docs' columns but the text, as `row`, its span, hash and features."""
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in _rest(docs, text_col)]).alias("row"), F.col(f"`{text_col}`").alias("text"), path.alias("path"))
    return packed.mapInArrow(partial(_candidate_rows, paths=vocabularies), f"row {packed.schema['row'].dataType.simpleString()}, {_ROW}")


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]], vocabularies: tuple[str, ...], trees: int = 60, depth: int = 10, seed: int = 11):
    """A fitted pipeline (vector assembly and forest) from labelled findings."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    words = words_of(vocabularies)
    rows = [(*features(v, b, a, p, words), float(label)) for v, b, a, p, label in findings]
    data = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double").coalesce(1)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="__x"), RandomForestClassifier(featuresCol="__x", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)]).fit(data)
    # the summary of the training holds the session, which can't be sent to executors once it has observed a query
    model.stages[-1]._java_obj.setSummary(spark._jvm.scala.Option.apply(None))
    return model


def scan(spark: SparkSession, docs: DataFrame, vocabularies: tuple[str, ...], findings=None, text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """docs' columns but the text, span, hash, probability and verdict of each candidate."""
    from pyspark.ml.functions import vector_to_array

    model = train(spark, findings or example_findings(words=words_of(vocabularies)), vocabularies)
    scored = model.transform(candidates(docs, vocabularies, text_col, path_col)).withColumn("chance", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in _rest(docs, text_col)], "start", "end", "value_sha256", F.col("chance").alias("probability"), (F.col("chance") >= threshold).alias("is_secret"))
