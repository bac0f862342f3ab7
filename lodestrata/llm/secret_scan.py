"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything is DataFrame functions and Spark ML's JVM code. A candidate's features are its
length, its character classes and how often they change, the share of it that a dictionary of
common words covers, the words around it, and the path of its text. The forest is trained on
labelled findings: any table (candidate, before, after, path, label). ``example_findings`` makes
one by rule, with keys, tokens and passwords on one side and commit ids, checksums, UUIDs,
placeholders, file names and encoded data on the other; a user passes their own instead.

Candidates are credentials of known formats, runs of 12 and more letters and digits, whatever of 4
and more characters is assigned to a password-like name (words, symbols and, in quotes, blanks
too), the password of a URL, and the head of a private key block. A candidate may have any length. Each keeps its own place in the text. Candidates are put together
inside the row, so an exploded row holds one of them and its context, never the text.

Defined results: null, empty and candidate-free texts give no rows; a null doc_id is carried
through; repeated rows give repeated findings, and so does a candidate that occurs again in its
text; ``start`` counts code points from 1; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH = 40, 7
#: Labelled findings that ``example_findings`` makes.
EXAMPLES = 10_000
#: Characters of context on either side.
CONTEXT = 48

# Formats of credentials whose beginning tells them.
KNOWN = {
    "aws_key": "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": "gh[pousr]_[0-9A-Za-z]{36}",
    "slack_token": "xox[abprs]-[0-9A-Za-z-]{10,72}",
    "google_key": "AIza[0-9A-Za-z_-]{35}",
    "stripe_key": "[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "gitlab_token": "glpat-[0-9A-Za-z_-]{20,}",
    "json_web_token": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
# Words by which a credential is assigned.
ASSIGNED = "passw|pass(?![a-z])|pwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|credential|auth"
# Words around numbers and hashes that are no credentials.
HARMLESS = "commit|revision|checksum|md5|sha1|sha256|hash|digest|integrity|uuid|guid|build|version|image|etag|example|sample|placeholder|dummy|test"
# Words of a line that asks for a password.
PROMPTS = r"\b(?:enter|your|please|must|type|choose|forgot|reset|new|here)\b"
# Common words and parts of identifiers.
DICTIONARY = (
    "about account action active address admin after array async author backup base before between binary block body bottom buffer build button "
    "cache call change character check child class client code color column comment commit common config connect content control count create current "
    "data database date default delete demo description dev directory document domain download dummy edit element email empty enable entry error event example "
    "external field file filter final first font format frame from function get global group handle handler hash header height help hidden home host html "
    "icon image import index info input insert internal item javascript job json key label language last left length level library like line link list load local "
    "location lock log login main manager master max menu message method min mode model module month name network next node none null number object offset open option "
    "order output package page param parent password path pattern place placeholder plugin point port position post prefix preview print private process product profile "
    "project property public query random read record region release remote remove render report request reset resource response result return right role root route row "
    "sample schema scope screen script search secret section select server service session set setting show simple size source start state static status step stop storage "
    "stream string style submit sub success suffix system table target task template test text the this thread time title token tool top total track type unique unit unknown "
    "update upload url user util valid value variable vector version video view visible web width window with word work worker wrap write xml year your"
).split()

_KNOWN = "|".join(f"(?:{p})" for p in KNOWN.values())
# Names that a value is assigned to; the value may be quoted.
_NAMED = r"(?i:password|passwd|(?<![a-z])pass|pwd|passphrase|passcode|secret|api[_-]?key|access[_-]?key|token|credentials?|auth)"
_ASSIGNED = _NAMED + r"[\"']?[ \t]{0,2}[:=][ \t]{0,2}"
_PEM = "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
# Cheap looks back come first: most places of a text aren't behind a sign.
_BARE = r"[^\s\"'<>,;(){}\[\]]"
_BEHIND_NAME = rf"(?<=[:= \t\"'])(?<=[:=][ \t]{{0,2}}[\"']?)(?<={_ASSIGNED}[\"']?)"
#: Characters of a URL's user name, at most, before a password (a look back has to end).
URL_USER = 512
#: A key block's head; a quoted (blanks and all) or bare value behind a name, or a quoted one behind its "is"; a URL's password; a known format; a run that mixes letters and digits.
PATTERN = (
    rf"{_PEM}|{_BEHIND_NAME}(?:(?<=\")[^\"\r\n]{{4,}}+(?=\")|(?<=')[^'\r\n]{{4,}}+(?=')|(?<![\"']){_BARE}{{4,}}+)"
    rf"|(?<=is [\"'])(?<={_NAMED} is [\"'])(?:(?<=\")[^\"\r\n]{{4,}}+(?=\")|(?<=')[^'\r\n]{{4,}}+(?='))"
    rf"|(?<=:)(?<=://[0-9A-Za-z._%+-]{{1,{URL_USER}}}:)[^\s@/:\"']{{4,}}+(?=@)"
    rf"|(?<![0-9A-Za-z_+/-])(?:{_KNOWN}|(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[0-9A-Za-z_+/-]{{12,}}={{0,2}})(?![0-9A-Za-z_+/@-])"
)
#: Texts without any of these hold no candidate: a digit, a sign of an assignment or URL, the dashes of a key block, a quotation behind "is".
_GATE = "[0-9:=-]| is [\"']"

FEATURES = ["length", "changes", "symbols", "distinct", "digits", "upper", "vowel_turns", "hex", "covered", "separators", "assigned", "harmless", "near_sign", "quoted", "known", "in_url", "in_path", "test_path", "prompt"]


def with_features(findings: DataFrame) -> DataFrame:
    """The findings (candidate, before, after, path) with a column of each feature, all doubles."""
    c, n = F.col("candidate"), F.length("candidate")
    count = lambda pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    low, before, path = F.lower(c), F.lower("before"), F.lower("path")
    near = F.substring(before, -20, 20)
    made: dict[str, Column] = {
        "length": F.least(n, F.lit(100)),
        "changes": (count("[a-z]+|[A-Z]+|[0-9]+|[^0-9A-Za-z]+") - 1) / F.greatest(n - 1, F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "vowel_turns": F.size(F.regexp_extract_all(low, F.lit("[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"), F.lit(0))) / n,
        "hex": c.rlike("^[0-9a-f]+$").cast("int"),
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))), "")) / n,
        "separators": count("[_/+-]") / n,
        "assigned": near.rlike(ASSIGNED).cast("int"),
        "harmless": F.concat(near, F.lit(" "), F.lower(F.substring("after", 1, 24))).rlike(HARMLESS).cast("int"),
        "near_sign": before.rlike(r"(?:[=:]|\bis)\s*[\"']?$").cast("int"),
        "quoted": before.rlike("[\"']$").cast("int"),
        "symbols": count("[^0-9A-Za-z_+/-]") / n,
        "known": c.rlike(f"^(?:{_KNOWN}|{_PEM})$").cast("int"),
        "in_url": before.rlike("://[^/ ]*:$").cast("int"),
        "in_path": F.concat(F.substring(before, -3, 3), low).rlike("[/\\\\.].*[/.]|://").cast("int"),
        "prompt": low.rlike(PROMPTS).cast("int"),
        "test_path": path.rlike("test|example|fixture|sample|mock|doc|lock").cast("int"),
    }
    return findings.select("*", *(F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES))


#: Lengths that are added up at once; sums of blocks are added up between them.
_SUM_BLOCK = 256


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that long arrays aren't copied for each element."""
    running = lambda values, start: F.aggregate(values, F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("sum")), lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum")), lambda s: s["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _SUM_BLOCK).cast("int")), lambda b: F.slice(sizes, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK)))
    starts = running(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, running))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, start, candidate, before, after, path for each candidate in the texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    docs = docs.where(F.col("text").rlike(_GATE)).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).where(F.size("found") > 0)
    docs = docs.select("doc_id", "path", "found", F.split("text", PATTERN, -1).alias("gaps"))
    docs = docs.withColumn("sizes", F.zip_with(F.slice("gaps", 1, F.size("found")), "found", lambda g, c: F.length(g) + F.length(c)))
    docs = docs.withColumn("ends", _sums_before(F.col("sizes")))

    def finding(c: Column, i: Column) -> Column:
        gap = F.get("gaps", i)
        return F.struct((F.get("ends", i) + F.length(gap) + 1).cast("long").alias("start"), c.alias("candidate"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(F.get("gaps", i + 1), 1, CONTEXT).alias("after"))

    return docs.select("doc_id", "path", F.explode(F.transform("found", finding)).alias("f")).select("doc_id", "f.start", "f.candidate", "f.before", "f.after", "path")


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(candidate, before, after, path, label): n labelled findings made by rule from the row number."""
    rows = spark.range(n).withColumn("a", F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 512)).withColumn("b", F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))
    draw = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("int")
    pick = lambda i, values: F.element_at(F.array(*map(F.lit, values)), draw(i, len(values)) + 1)
    mixed = F.regexp_replace(F.base64(F.unhex("a")), "[+/=]", "")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex("b")), "[+/=]", ""))
    word = lambda i: pick(i, [w for w in DICTIONARY if len(w) > 4])
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    is_key = pick(4, ["password", "PASSWORD", "db_passwd", "secret", "token", "auth_token", "api_key", "client_secret", "access-key"])
    is_password = pick(54, ["password", "PASSWORD", "db_password", "passwd", "pwd", "passphrase", "admin_password", "secret"])
    sign = pick(5, ["=", " = ", ": ", "=\"", " = \"", ": '"])
    kinds: list[tuple[Column, Column, int]] = [  # (candidate, before, label)
        (F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16))), F.concat(prose, F.lit(" ")), 1),
        (F.concat(F.lit("AKIA"), F.substr(upper, F.lit(9), F.lit(16))), F.concat(prose, F.lit(" aws "), sign), 1),
        (F.substr("a", F.lit(1), 12 + draw(6, 29)), F.concat(prose, F.lit(" "), is_key, sign), 1),
        (F.substr("a", F.lit(1), F.lit(40)), F.concat(prose, F.lit(" "), is_key, sign), 1),
        (F.substr(mixed, F.lit(1), 16 + draw(7, 33)), F.concat(prose, F.lit(" "), is_key, sign), 1),
        (F.concat(F.lit("ghp_"), F.substr(mixed, F.lit(1), F.lit(36))), F.concat(prose, F.lit(" ")), 1),
        (F.substr("b", F.lit(1), F.lit(40)), F.concat(prose, F.lit(" "), pick(8, ["commit", "revision", "sha1", "Merge", "parent"]), F.lit(" ")), 0),
        (F.substr("b", F.lit(1), pick(9, [32, 40, 64])), F.concat(prose, F.lit(" "), pick(10, ["md5", "checksum", "sha256", "integrity", "digest", "etag", "hash"]), sign), 0),
        (F.concat_ws("-", *(F.substr("b", F.lit(x), F.lit(y)) for x, y in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.concat(prose, pick(11, [" ", " uuid ", " id=", " guid: "])), 0),
        (F.concat_ws("_", word(12), word(13), draw(14, 100).cast("string")), F.concat(prose, pick(15, [" ", " = ", " name: ", " token = "])), 0),
        (F.concat(word(16), F.initcap(word(17)), F.initcap(word(18)), draw(19, 10).cast("string")), F.concat(prose, F.lit(" ")), 0),
        (F.concat(pick(20, ["EXAMPLE", "YOUR_TOKEN", "changeme_password", "placeholder_key", "xxxxxxxxxxxx"]), draw(21, 1000).cast("string"), F.lit("000")), F.concat(prose, F.lit(" "), is_key, sign), 0),
        (F.concat(word(22), F.lit("/"), word(23), F.lit("/v"), draw(24, 10).cast("string")), F.concat(prose, F.lit(" https://"), word(25), F.lit(".")), 0),
        (F.base64(F.concat(F.unhex("a"), F.unhex("b"))), F.concat(prose, F.lit(" data:image/png;base64,")), 0),
        # passwords that people choose, and what else stands behind such a name
        (F.concat(word(29), draw(30, 1000).cast("string"), pick(31, list("!?#$%&*.x")), F.substr(mixed, F.lit(40), draw(32, 5))), F.concat(prose, F.lit(" "), is_password, sign), 1),
        (F.translate(F.substr("a", F.lit(60), 14 + draw(55, 16)), "0123456789abcdef", "aeioutnrslcdhmpy"), F.concat(prose, F.lit(" "), is_password, sign), 1),
        (F.concat(word(33), word(34), word(35)), F.concat(prose, F.lit(" "), is_password, sign), 1),
        (F.concat(F.substr(mixed, F.lit(20), 6 + draw(36, 10)), pick(37, ["", "!", "@1", "#x", "$"])), F.concat(prose, F.lit(" "), is_password, sign), 1),
        (F.concat(word(38), draw(39, 10000).cast("string"), F.substr(mixed, F.lit(50), F.lit(4))), F.concat(prose, F.lit(" "), pick(40, ["postgres", "https", "amqp", "redis", "mysql"]), F.lit("://"), word(41), F.lit(":")), 1),
        (F.concat(F.lit("-----BEGIN "), pick(42, ["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), F.lit("PRIVATE KEY-----")), F.concat(prose, F.lit(" ")), 1),
        (pick(43, ["required", "optional", "string", "invalid", "expired", "missing", "undefined", "hidden", "disabled", "changeme", "redacted", "********", "xxxxxxxx", "<secret>", "forgotten", "Bearer", "nullable", "varchar", "boolean", "unknown"]), F.concat(prose, F.lit(" "), is_key, sign), 0),
        (F.concat(pick(44, ["os.environ", "process.env", "config", "settings", "self", "request", "params", "getenv"]), F.lit("."), word(45)), F.concat(prose, F.lit(" "), is_key, sign), 0),
        (F.concat(pick(46, ["${", "$", "%", "{{"]), F.upper(word(47)), F.lit("_"), F.upper(word(48)), pick(49, ["}", "", "%", "}}"])), F.concat(prose, F.lit(" "), is_key, sign), 0),
        (pick(50, ["password", "PASSWORD", "example", "password123", "yourpassword", "user_password", "secret_name", "token_type"]), F.concat(prose, pick(51, [" https://user:", " secret: ", " password=", " token: "])), 0),
        (F.concat_ws(" ", word(56), word(57), word(58), word(59)), F.concat(prose, F.lit(" "), pick(60, ["passphrase", "password", "pass phrase", "db_pass"]), pick(61, ["=\"", ": \"", " is \"", " = \""])), 1),
        (F.concat_ws(" ", *(F.translate(F.substr("b", F.lit(k), 3 + draw(k, 5)), "0123456789abcdef", "aeioutnrslcdhmpy") for k in (70, 78, 86, 94))), F.concat(prose, F.lit(" "), pick(71, ["passphrase", "password", "passcode", "db_pass"]), pick(72, ["=\"", ": \"", " is \"", " = \""])), 1),
        (F.substr(mixed, F.lit(30), 4 + draw(62, 3)), F.concat(prose, F.lit(" "), pick(63, ["pwd", "pass", "password", "db_pass"]), sign), 1),
        (F.concat_ws(" ", pick(64, ["enter", "your", "must not", "please type", "reset", "no", "the"]), word(65), word(66), word(67)), F.concat(prose, F.lit(" "), is_password, pick(68, ["=\"", ": \"", " = \"", " placeholder=\""])), 0),
        (F.lower(word(52)), F.concat(prose, F.lit(" "), pick(53, ["the secret: ", "A token: ", "no password: ", "the auth: "])), 0),
    ]
    which, made = F.pmod(F.col("id"), F.lit(len(kinds))), None
    path = {1: pick(26, ["", "", "src/app.py", "config/prod.env", "test/fixture.json"]), 0: pick(27, ["", "", "src/app.py", "docs/example.md", "test/fixture.json", "package.lock"])}
    for first in range(0, len(kinds), 10):  # some kinds at a time, as generated code has a bound
        some = dict(enumerate(kinds[first : first + 10], first))
        choose = lambda i: F.coalesce(*(F.when(which == k, kind[i]) for k, kind in some.items()))  # noqa: E731, B023
        label = F.coalesce(*(F.when(which == k, F.lit(kind[2])) for k, kind in some.items()))
        part = rows.where(which.between(first, first + len(some) - 1)).select("id", choose(0).alias("candidate"), choose(1).alias("before"), label.cast("double").alias("label"))
        made = part if made is None else made.unionByName(part)
    return made.select("candidate", "before", F.concat(F.lit(" "), word(28)).alias("after"), F.when(F.col("label") == 1, path[1]).otherwise(path[0]).alias("path"), "label")


def train(findings: DataFrame, seed: int = 11) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings)).select("features", "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    # the summary of the training holds the session, which tasks can't always take with them
    model._java_obj.setSummary(findings.sparkSession._jvm.scala.Option.empty())
    return model


def scan(docs: DataFrame, path: Column, model: RandomForestClassificationModel) -> DataFrame:
    """doc_id, start, length, kind, secret_sha256, score, kept for each candidate; false positives are not kept."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, path)))
    formats = {**KNOWN, "private_key": _PEM}
    kind = F.coalesce(*(F.when(F.col("candidate").rlike(f"^{p}$"), F.lit(name)) for name, p in formats.items()), F.when(F.col("in_url") == 1, F.lit("url_password")), F.when(F.col("assigned") == 1, F.lit("assigned")), F.lit("generic"))
    rows = model.transform(rows.withColumn("kind", kind)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return rows.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), "kind", F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), "score", (F.col("score") >= 0.5).alias("kept"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents; a document's source is its path."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source"), train(example_findings(spark)))
