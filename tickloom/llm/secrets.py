"""Secret scans whose false positives a random forest removes, in DataFrame and Spark ML operations only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, text_key, unused

#: Names that stand before secrets, and words that stand by digests which are none.
NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
HARMLESS = "sha1|sha256|sha512|md5|commit|checksum|digest|revision|uuid|guid|etag|isbn|order|invoice|example|sample|placeholder|dummy|request|trace|image|public"
TEST_PATHS = "test|example|sample|doc|fixture|mock"
#: Words that candidates of no secret are often made of.
DICTIONARY = "example|sample|dummy|test|your|here|changeme|placeholder|redacted|required|optional|secret|token|password|passwd|bearer|key|none|null|true|false|http|https|www|com|org|net|mail|html|page|index|file|path|name|user|data|license|version|local|share|config|value|type|abcdef|0123456789|123456|xxxx|0000|get|set|env|api"  # noqa: S105
# every part is possessive or bounded, so that long runs of one kind cost time in proportion to their length
_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{32,}+={0,2})++)"
_NAMED = rf"""(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?i:{NAMES}))[A-Za-z0-9_-]++["']?\s{{0,4}}(?:=>?|:)\s{{0,4}}(?:Bearer\s{{1,4}})?"""
_VALUE = r"""(?:"[^"\n]{4,}|'[^'\n]{4,}|[^\s"'<>,;&]{4,})"""
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Z]*+[a-z+/_-]++[A-Z])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9=]))?"
#: A candidate: a private key's block, or where its end is missing its header with the lines of base64 behind it; what is assigned to a secret's name, of 4 characters or more; or 16 or more characters of keys and tokens with a digit or with a capital behind a small letter or a mark.
CANDIDATE = f"{_PEM}|{_NAMED}{_VALUE}|{_RUN}"
#: Documents whose text stands around the findings that are made for training, at most: those of the smallest hashes of their ids.
FIT_DOCUMENTS = 400
#: Kinds of findings that are made for training.
KINDS = 38
#: Characters of neighbouring words that the forest sees on each side.
CONTEXT = 64
_OPEN, _CLOSE = "\x01", "\x02"


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """One row for each candidate of a text: doc_id, text_key, path, start, end (characters from 0), candidate, before, after; other columns whose names begin with `__` stay.

    One pass of the pattern marks the candidates; the marked text is split, and lengths before a candidate are summed over
    the pieces of its row.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _OPEN + _CLOSE, "  ")
    more = [c for c in docs.columns if c.startswith("__")]
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), *more, F.regexp_replace(text, CANDIDATE, f"{_OPEN}$0{_CLOSE}").alias("marked"))
    rows = rows.where(F.contains("marked", F.lit(_CLOSE))).withColumn("row", F.monotonically_increasing_id())
    pieces = F.transform(F.split("marked", _CLOSE, -1), lambda x: F.split(x, _OPEN, -1))
    rows = rows.select("doc_id", "text_key", "path", *more, "row", pieces.alias("p"))
    last, own = (lambda i: F.concat(F.coalesce(F.get("p", i - 1)[1], F.lit("")), F.get("p", i)[0])), (lambda i: F.get("p", i)[1])
    after = lambda i: F.concat(F.get("p", i + 1)[0], F.coalesce(F.get(F.get("p", i + 1), F.lit(1)), F.lit("")))
    each = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.length(F.get("p", i)[0]).alias("gap"), own(i).alias("hit"), F.right(last(i), F.lit(CONTEXT)).alias("before"), F.left(after(i), F.lit(CONTEXT)).alias("after")))
    rows = rows.select("doc_id", "text_key", "path", *more, "row", F.posexplode(each).alias("at", "x")).select("doc_id", "text_key", "path", *more, "row", "at", "x.*")
    upto = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("int"))
    name = F.regexp_extract("hit", rf"^{_NAMED}[\"']?", 0)
    name = F.when(F.length("hit") - F.length(name) >= 4, name).otherwise(F.lit(""))
    return rows.withColumn("name", name).select(
        "doc_id", "text_key", "path", *more, (F.col("end") - F.length("hit") + F.length("name")).alias("start"), "end", F.expr("substring(hit, length(name) + 1)").alias("candidate"),
        F.right(F.concat("before", "name"), F.lit(CONTEXT)).alias("before"), "after",
    )


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """`found` with a column of doubles for each feature, and their names: length, character transitions, dictionary coverage, path and neighbouring words."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    letters = F.split(c, "")
    shares = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    before, after, where = F.lower("before"), F.lower("after"), F.lower(F.coalesce("path", F.lit("")))
    made = {
        "f_length": n,
        "f_entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_lower": count("[a-z]") / n,
        "f_marks": count("[+/_=-]") / n,
        "f_letter_digit": count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "f_lower_upper": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "f_spaces": count(r"\s") / n,
        "f_repeats": count(r"(.)(?=\1)") / n,
        "f_vowels": count("[aeiou]", low) / n,
        "f_hex": F.when(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0),
        "f_dictionary": 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / n,
        "f_name_before": F.when(before.rlike(rf"(?:{NAMES})[a-z0-9_-]{{0,24}}\W{{0,8}}(?:bearer )?$"), 1.0).otherwise(0.0),
        "f_name_near": F.when(before.rlike(NAMES), 1.0).otherwise(0.0),
        "f_assigned": F.when(before.rlike("[=:]\\s*[\"']?$"), 1.0).otherwise(0.0),
        "f_quoted": F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1.0).otherwise(0.0),
        "f_harmless_near": F.when(before.rlike(HARMLESS) | after.rlike(HARMLESS), 1.0).otherwise(0.0),
        "f_part_of_address": F.when(before.rlike(r"[@./]$") | after.rlike(r"^[@.]\w"), 1.0).otherwise(0.0),
        "f_path_test": F.when(where.rlike(TEST_PATHS), 1.0).otherwise(0.0),
    }
    return found.withColumns(made), list(made)


def _made(some: DataFrame) -> DataFrame:
    """Rows of `some` (doc_id, path, seed, around) once for each kind of finding, with `made`, a text of known truth, and `secret`, what is secret in it, or null."""
    key = F.concat_ws("/", F.col("seed").cast("string"), F.col("kind").cast("string"))
    rows = some.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))))
    rows = rows.select("doc_id", "path", "around", "kind", F.xxhash64("seed", "kind").alias("r"), F.sha2(key, 256).alias("h"), F.sha2(F.concat(key, F.lit("/")), 256).alias("g"))
    b, two = F.base64(F.unhex("h")), F.concat(F.base64(F.unhex("h")), F.base64(F.unhex("g")))

    def pick(at: int, *of) -> Column:
        return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), F.pmod(F.shiftright("r", at), F.lit(len(of))).cast("int") + 1)

    words = ("river", "stone", "maple", "cloud", "amber", "falcon", "copper", "meadow", "harbor", "violet", "winter", "rocket")
    names = ("token", "api_key", "secret", "password", "client_secret", "ACCESS_TOKEN", "auth_token", "AWS_SECRET_ACCESS_KEY", "db_password", "apiKey", "private_key", "PASSWD")
    w = [F.col(f"w{i}") for i in range(4)]
    # written here, so that the plans of what follows stay small
    rows = settled(rows.select("*", b.alias("b"), F.translate(two, "+/=\r\n", "").alias("n"), *(pick(4 * i, *words).alias(f"w{i}") for i in range(4)), pick(17, *names).alias("name")))
    kind, n, cat = F.col("kind"), F.col("n"), F.concat
    formats = [cat(F.lit("AKIA"), F.upper(F.left(n, F.lit(16)))), cat(F.lit("ghp_"), F.left(n, F.lit(36))), cat(pick(23, "sk_live_", "xoxb-", "glpat-"), F.left(n, F.lit(24)))]
    named = [
        F.left("h", pick(21, 32, 40, 64)), F.col("b"), F.left(n, pick(22, 20, 24, 32, 40)), *formats, cat(F.left(n, pick(24, 8, 10, 12)), pick(25, "!", "#", "", "$")),
        F.left(F.translate(n, "0123456789", "qwertyuiop"), pick(26, 12, 18, 24)), cat(*w),
    ]
    pem = cat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.col("b"), F.lit("\n"), F.base64(F.unhex("g")), F.lit("\n-----END RSA PRIVATE KEY-----"))
    yes = [*named, *named, pem, F.left(n, F.lit(40)), F.left(n, F.lit(32)), *formats]
    digest = F.left("h", pick(21, 32, 40, 64))
    uuid = F.regexp_replace(F.left("h", F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    no_named = [  # under a secret's name
        pick(27, "your_token_here", "YOUR_API_KEY", "xxxxxxxxxxxxxxxx", "changeme", "example_password", "${SECRET_TOKEN}", "********", "0123456789abcdef", "aaaaaaaaaaaaaaaaaaaa", "required"),
        pick(28, "none", "null", "os.environ", "test_token_1234", "redacted", "bearer", "get_token(user)", "optional", "string", "your_secret_here"),
        pick(29, "placeholder", "<password>", "changeme123", "xxxx-xxxx-xxxx", "example", "true", "dummy_token_000"),
    ]
    no = [
        cat(pick(30, "commit ", "sha256: ", "revision ", "checksum = \"", "md5 ", "ETag: \"", "image@sha256:", "digest: ", "trace id "), digest), cat(pick(31, "commit ", "sha256: ", "build ", "image@sha256:"), digest), cat(pick(32, "uuid ", "request id: ", "guid = ", ""), uuid),
        cat(pick(33, "order ", "invoice ", "phone ", "card ", "isbn "), F.left(F.translate("h", "abcdef", "123456"), pick(34, 16, 18, 20))), cat(w[0], F.lit("_"), w[1], F.lit("_"), w[2], F.lit("_2")), cat(w[0], F.initcap(w[1]), F.initcap(w[2]), F.initcap(w[3])),
        cat(F.lit("/usr/local/share/"), w[0], F.lit("/v2/"), w[1]), cat(F.lit("data:image/png;base64,"), F.col("b"), F.col("b")), cat(F.lit("ssh-rsa AAAAB3NzaC1yc2E"), F.col("b"), F.lit(" public key")),
        cat(F.lit("the auth: "), w[0], F.lit(" and token: "), w[1]), cat(F.lit("see https://www.host.org/page/"), w[0], F.lit("-2024-index.html")),
    ]
    value = F.element_at(F.array(*yes, *no_named, *no), kind + 1)
    rows = rows.select("doc_id", "path", "around", "kind", "r", "name", value.alias("value"))
    forms = [cat("name", F.lit(a), "value", F.lit(z)) for a, z in ((' = "', '"'), (": '", "'"), ("=", ""), ('": "', '",'), (": ", ""), (" => '", "'"), ("=", "&page=2"), (' = "', '";'))]
    secret = len(yes)
    made = F.when((kind < 2 * len(named)) | kind.between(secret, secret + len(no_named) - 1), pick(36, *forms)).when(kind == 2 * len(named) + 1, cat(F.lit("Authorization: Bearer "), "value"))
    made = made.when(kind == 2 * len(named) + 2, cat(F.lit("https://api.host.io/v1?token="), "value")).when(kind.between(2 * len(named) + 3, secret - 1), cat(pick(37, "we use ", "key ", "", "log in by "), "value")).otherwise(F.col("value"))
    return rows.select("doc_id", "path", "around", "kind", made.alias("made"), F.when(kind < secret, F.col("value")).alias("secret"))


def labelled_findings(docs: DataFrame, documents: int = FIT_DOCUMENTS, salt: int = 0, path: str | None = "source") -> DataFrame:
    """Candidates with `label` 1 or 0, where people have labelled none: secrets and values that are none, made by _made(), each in a text of the corpus.

    The truth is what was put in, not a rule over what the forest sees: the same names stand before secrets and
    placeholders, and the same alphabets are secrets and digests. Words around come from `documents` documents.
    """
    some = docs.select("doc_id", (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    some = some.withColumn("seed", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(salt)))
    at = F.pmod("seed", F.greatest(F.length("text"), F.lit(1))).cast("int")
    # only a few words of each text go to the choice of documents
    some = some.select("doc_id", "path", "seed", F.substring(F.col("text"), at + 1, F.lit(160)).alias("around")).orderBy("seed", "path").limit(documents)
    some = settled(some.withColumn("around", F.regexp_replace("around", CANDIDATE, " ")))
    half = F.floor(F.length("around") / 2).cast("int")
    rows = _made(some)
    mark = F.when(F.pmod(F.hash("kind", "around"), F.lit(2)) == 0, " ").otherwise("\n")
    text = F.concat(F.left(F.col("around"), half), mark, F.col("made"), mark, F.expr("substring(around, cast(floor(length(around) / 2) as int) + 1)"))
    planted = settled(rows.select("doc_id", "path", text.alias("text"), F.col("secret").alias("__secret")))  # so that the plan of what follows stays small
    found = candidates(planted, "path")
    held = F.contains("__secret", F.col("candidate")) | F.contains("candidate", F.col("__secret"))
    found = found.withColumn("label", F.when(F.coalesce(held, F.lit(False)), 1.0).otherwise(0.0)).drop("__secret")
    # a forest samples rows by where they lie: one part, of a bounded number of rows, in one order, whatever the layout of `docs`
    return found.repartition(1).sortWithinPartitions(*found.columns)


def train(labelled: DataFrame, trees: int = 40, depth: int = 10) -> RandomForestClassificationModel | None:
    """A forest of labelled findings; None where there are none."""
    rows, names = features(settled(labelled))
    rows = settled(VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label"))
    if rows.isEmpty():
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows)


def scored(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """`found` with `score`, the forest's share of votes for a secret, and `is_secret` (0.5 or more). Without a model nothing is removed: all score 1."""
    if model is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    rows, names = features(found)
    votes = vector_to_array("probability")
    share = F.coalesce(F.get(votes, F.lit(1)), F.lit(0.0))  # a forest that knows only label 0 has one class
    out = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return out.select(*found.columns, share.alias("score")).withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, path: str | None = "source", labelled: DataFrame | None = None, documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Candidates of `docs` (doc_id, text and the column `path`) with `score` and `is_secret` (score >= 0.5).

    The forest is trained on `labelled` (columns of candidates() and label), else on labelled_findings() made in texts of
    `documents` documents. Null and empty texts have no candidates. Repeated rows have theirs again. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", *([path] if path else []))
    found = settled(candidates(docs, path))
    return scored(found, train(labelled_findings(docs, documents, path=path) if labelled is None else labelled))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret of `findings` in `text` replaced by `mark`; n_chars, if there, counts anew.

    Findings belong to a doc_id (null too) and a text, so rows that share an id have their own. Null texts stay null.
    """
    at, key, cut, own, hit = unused(docs, "id", "key", "spans", "own", "found")
    spans = findings.where("is_secret").groupBy(F.col("doc_id").alias(at), F.col("text_key").alias(key))
    spans = spans.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut))
    text = F.col("text")
    upto = lambda i: F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))
    pieces = F.transform(cut, lambda x, i: F.concat(F.substring(text, upto(i) + 1, x["start"] - upto(i)), F.lit(mark)))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(cut, -1)["end"] + 1, F.length(text)))
    found = F.col(cut).isNotNull() & text.isNotNull()
    out = docs.withColumn(own, text_key(text)).join(spans, (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(at)), "left")
    out = out.withColumn(hit, found).withColumn("text", F.when(found, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
