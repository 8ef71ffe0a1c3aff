"""Secret scans: candidate strings, and a random forest that removes the false positives.

Everything is built-in SQL functions and the forest of Spark's ML library. A document without a candidate
costs one regular expression; of the others only the candidates, with 40 characters on either side, are
shuffled, and equal texts under one path are judged once. A candidate is a whole value: what stands between quotes or up to a
space behind a word like ``token`` and ``=`` or ``:``, the password of a URL, a private key from its first to its last line, what follows
``bearer``, or any long run with a digit. Features are its length, entropy and character transitions (class changes, and how
unlikely its letter pairs are in the corpus), the share of it that dictionary words cover, its path and the neighbouring
words with the log-odds that labelled findings give them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.storage import free_name, scratch, written

THRESHOLD = 0.5
REDACTED = "<SECRET>"
CONTEXT = 40
# Documents whose ids and first words dress the labelled findings, in hash order.
SAMPLE_DOCUMENTS = 160
TREES, DEPTH, SEED = 40, 8, 7

_CALLED = (r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|auth|encryption|account)[_-]?key|connection[_-]?string)"
           r"[\"']?\s{0,3}")
_ASSIGNED = _CALLED + r"[:=]\s{0,3}"
_RUN = r"[A-Za-z0-9+/_~-]"
_LONG = rf"(?<![A-Za-z0-9+/_.~-])(?=[A-Za-z+/_.~-]*+[0-9]){_RUN}[A-Za-z0-9+/_.~-]{{14,}}{_RUN}={{0,2}}"
_PEM = (r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----(?:[\s\S]{0,20000}?-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----"
        r"|(?:\s{1,4}[A-Za-z0-9+/=]{16,})*)")
# In pairs what stands before a candidate and the candidate; of two that begin at one place the first counts.
_KINDS = [
    ("", _PEM),
    (r"://[^\s/:@\"']{1,64}:", r"[^\s/@\"']{3,}(?=@)"),
    # Looked for from the sign that assigns, which is rare, back to what is called so.
    (rf"(?=[:=])(?<={_CALLED})[:=]\s{{0,3}}[\"']?", r"""(?<=")[^"\n]{4,}(?=")|(?<=')[^'\n]{4,}(?=')|[^\s"']{5,}[^\s"'.,;:!?)\]}]"""),
    (r"(?=[Bb])(?i:\b(?:bearer|basic))\s{1,3}", r"(?=[A-Za-z+/_.~-]*+[0-9=]|[A-Z]*+[a-z]+[A-Z])[A-Za-z0-9+/_.~-]{8,}={0,2}"),
    ("", _LONG),
]
_ANY = "|".join(f"({before})({value})" for before, value in _KINDS)
_MARKED = ("".join(f"${2 * n + 1}" for n in range(len(_KINDS))) + "\x01" + "".join(f"${2 * n + 2}" for n in range(len(_KINDS))) + "\x02")

# Common words, longest first where one starts another.
_DICTIONARY = (
    "about access action address after again album android another apple archive article author basic because before "
    "block blog board book browser build button cache camera category change channel class client cloud code comment "
    "company config content control country create custom data date default delete demo design detail device document "
    "domain download edit email engine error event example export file filter first folder form format forum function "
    "game gallery global group guide handler header health help home house html http image import index info input "
    "item java label language library license life light line link list local login manager master media member menu "
    "message method mobile model module money music name network news null number object office online option order "
    "page param password path people phone photo place placeholder plan play point policy popular post power press price print "
    "private process product profile program project public query read release report request resource response "
    "result review sample school script search section security select server service session setting share shop "
    "simple site size social software source sport start state static status storage store story string style support "
    "system table team template test text theme time title token tool topic total travel true type update upload user "
    "value version video view water week width window with word work world year your").split()
# Letter pairs, words and neighbours that are learnt from the findings at most.
MOST_PAIRS, MOST_WORDS, MOST_NEIGHBOURS = 1500, 200, 300
_BENIGN = r"(?i)(sha-?\d*|commit|digest|checksum|md5|etag|uuid|guid|integrity|hash|version|build|isbn|card|phone|order|invoice|ref|revision|image|file|tracking|serial|id)\W{0,3}$"
_PLACEHOLDER = r"(?i)^[<$%{\[(]|[<>{}]|environ|getenv|process\.env|\(\)|^(none|null|true|false|undefined)$|example|dummy|change_?me|placeholder|your[_-]|sample|x{4,}|0{6,}|1234|abcd|test|todo|redacted"
_TEST_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|docs?|fixtures?|mocks?|node_modules|vendor|lock|min)([/_.-]|$)"

FEATURES = ["length", "entropy", "transitions", "surprise", "neighbours", "spaces", "punctuation", "distinct", "digits", "uppers", "vowels", "hexadecimal", "dictionary",
            "known_prefix", "assigned", "benign", "placeholder", "quoted", "near_words", "test_path", "path_depth"]


@dataclass
class Learned:
    """What features know from the findings' own surroundings: log-probabilities of letter pairs, frequent words, log-odds of words beside a secret."""

    pairs: dict[str, float]
    words: list[str]
    odds: dict[str, float]


def learn(findings: DataFrame) -> Learned:
    """Counts over the contexts of labelled findings; only the most frequent pairs and words, a bounded number, reach the driver."""
    known = findings.where("label in (0, 1)").select(
        "label", F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    words = known.select("label", F.explode("words").alias("word"))
    each = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counted = words.where("length(word) > 1").select(F.explode(each).alias("pair")).groupBy("pair").count()
    total = counted.agg(F.sum("count")).first()[0] or 1
    pairs = {r["pair"]: log2(r["count"] / total) for r in counted.orderBy(F.desc("count"), "pair").limit(MOST_PAIRS).collect()}
    frequent = words.where("length(word) >= 4").groupBy("word").count().orderBy(F.desc("count"), "word").limit(MOST_WORDS).collect()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    beside = known.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).where("n1 + n0 >= 5")
    ratio = F.log((F.col("n1") + 1) / (sizes.get(1, 0) + 2)) - F.log((F.col("n0") + 1) / (sizes.get(0, 0) + 2))
    odds = beside.select("word", ratio.alias("odds")).orderBy(F.desc(F.abs("odds")), "word").limit(MOST_NEIGHBOURS).collect()
    return Learned(pairs, sorted(r["word"] for r in frequent), {r["word"]: r["odds"] for r in odds})


NOTHING_LEARNT = Learned({}, [], {})


def candidates(docs: DataFrame, keep: list[str], path: Column) -> DataFrame:
    """One row per candidate string: columns ``keep``, path, text_key, ordinal, gap, candidate, before, after.

    ``gap`` is the number of characters since the candidate before.
    """
    found = docs.where(F.col("text").rlike(_ANY)).select(
        *keep, F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.sha2("text", 256).alias("text_key"), parts("text").alias("parts"))
    spot = ("transform(sequence(1, size(parts) - 2, 2), i -> struct(cast((i + 1) / 2 as int) as ordinal, "
            "length(parts[i - 1]) as gap, parts[i] as candidate, "
            f"right(parts[i - 1], {CONTEXT}) as before, left(parts[i + 1], {CONTEXT}) as after))")
    return found.where("size(parts) > 2").select(*keep, "path", "text_key", F.expr(f"inline({spot})"))


def parts(text: str) -> Column:
    """The text cut before and after each candidate: candidates are at every second place."""
    plain = F.translate(F.col(text), "\x01\x02", "  ")
    return F.split(F.regexp_replace(plain, _ANY, _MARKED), "[\x01\x02]")


def _table(values: dict[str, float]) -> Column:
    """A literal map; its keys are letters."""
    if not values:
        return F.expr("map('', 0.0D)")
    return F.expr("map({})".format(", ".join(f"'{key}', {value!r}D" for key, value in values.items())))


def features(findings: DataFrame, learned: Learned = NOTHING_LEARNT) -> DataFrame:
    """``findings`` (candidate, before, after, path) with the columns ``FEATURES``; nulls count as empty."""
    c, before, after, path = (F.coalesce(F.col(n), F.lit("")) for n in ("candidate", "before", "after", "path"))
    size = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]+", "l"), "[A-Z]+", "U"), "[0-9]+", "9"), "[^lU9]+", "-")
    chars = F.split(c, "")
    kinds = F.array_distinct(chars)
    entropy = F.aggregate(kinds, F.lit(0.0), lambda total, kind: total - (
        F.size(F.filter(chars, lambda x: x == kind)) / size) * F.log2(F.size(F.filter(chars, lambda x: x == kind)) / size))
    dictionary = {*_DICTIONARY, *learned.words}
    covered = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), ""))
    lower = F.lower(c)
    both = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: lower.substr(i, F.lit(2))),
                    lambda pair: pair.rlike(r"^\p{L}{2}$"))
    rarest = min(learned.pairs.values(), default=0.0) - 1
    pairs, odds = _table(learned.pairs), _table(learned.odds)
    surprise = F.aggregate(both, F.lit(0.0), lambda sum_, pair: sum_ - F.coalesce(F.try_element_at(pairs, pair), F.lit(rarest)))
    near = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", before, after)), F.lit(r"\p{L}+"), F.lit(0)))
    evidence = F.aggregate(near, F.lit(0.0), lambda sum_, word: sum_ + F.coalesce(F.try_element_at(odds, word), F.lit(0.0)))
    flag = lambda condition: F.coalesce(condition.cast("double"), F.lit(0.0))
    columns = {
        "length": F.least(F.length(c), F.lit(400)).cast("double"), "entropy": entropy,
        "transitions": F.length(classes) / size, "surprise": surprise / F.greatest(F.size(both), F.lit(1)), "neighbours": evidence,
        "spaces": share(" "), "punctuation": share(r"[^\p{L}\p{N}\s]"), "distinct": F.size(kinds) / size,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "vowels": share("[aeiouAEIOU]"),
        "hexadecimal": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "dictionary": 1 - covered / size,
        "known_prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|npm_|xox[abp]-|sk_live_|rk_live_|AIza|eyJ|SG[.]|-----BEGIN)")),
        "assigned": flag(before.rlike(_ASSIGNED + "[\"']?$") | before.rlike(r"(?i)(bearer|basic)\s+$") | before.rlike(r"://[^\s/:@]{1,64}:$")),
        "benign": flag(before.rlike(_BENIGN)), "placeholder": flag(c.rlike(_PLACEHOLDER)),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "near_words": F.regexp_count(F.concat(before, after), F.lit(r"\p{L}{3,}")).cast("double"),
        "test_path": flag(path.rlike(_TEST_PATH)), "path_depth": F.least(F.regexp_count(path, F.lit("/")), F.lit(20)).cast("double"),
    }
    named = {name: F.coalesce(columns[name], F.lit(0.0)).alias(name) for name in FEATURES}
    taken = [n for n in findings.columns if n not in named]
    return findings.select(*taken, *named.values())


def labelled_findings(docs: DataFrame, path: Column, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(candidate, before, after, path, label) to learn from when no reviewed findings are at hand.

    Strings derived from document ids stand between the first words of those documents, once in contexts
    that make them secrets (label 1) and once as commits, digests, identifiers, numbers and placeholders (0).
    """
    dressed = (docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
                           F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("words"))
               .where("id is not null").orderBy(F.xxhash64("id"), "id", "words").limit(sample))
    values = dressed.selectExpr(
        "id", "path", "words", "md5(id) as h32", "sha1(id) as h40", "sha2(id, 256) as h64",
        "regexp_replace(base64(unhex(sha2(concat('b', id), 256))), '[=]', '') as b43",
        "cast(pmod(xxhash64(id), 9000000000000000L) + 1000000000000000L as string) as d16",
        "regexp_replace(lower(left(words, 24)), '[^a-z]+', '_') as slug", "pmod(xxhash64(id), 40) as turn")
    values = values.selectExpr(
        "*", "substr('!@#$%&*?^', cast(1 + turn % 9 as int), 1) as mark", "initcap(replace(left(slug, 7), '_', '')) as name",
        "rpad(replace(slug, '_', ''), 18, 'quietriverstones') as joined", "array_join(transform(sequence(1, 6), i -> "
        "left(base64(unhex(concat(sha2(concat(id, cast(i as string)), 256), sha2(concat('p', id, cast(i as string)), 256)))), 64)), '\n') as lines")
    # Values by the SQL that makes them, each with what stands before it (``{user}``: a name), how it ends and its label.
    found: list[tuple[str, str, str, int]] = []

    def add(label: int, end: str, befores: tuple[str, ...], *made: str) -> None:
        found.extend((value, before, end, label) for before in befores for value in made)

    add(1, "quoted", ('token = "', 'api_key: "', 'secret="', 'password = "', 'pwd: "', 'client_secret = "', 'passphrase="'),
        "h40", "left(b43, 24 + turn div 3)", "concat('a', left(b43, 19))", "concat(left(b43, 6), mark, substr(b43, 8, 9), mark, left(d16, 2))",
        "concat(name, left(d16, 3), mark, turn)", "joined", "concat(replace(left(slug, 14), '_', '-'), mark, left(joined, 7), turn % 10)",
        "concat(left(joined, 3), '.', substr(joined, 4, 3), '.', substr(joined, 7, 11))")
    add(1, "plain", ("token=", "password: ", "api-key="), "h64", "left(b43, 12)", "concat(left(b43, 8), mark, left(d16, 4))")
    add(1, "plain", ("", "use ", "key "), "concat('AKIA', upper(left(h32, 16)))", "concat('ghp_', left(b43, 36))", "concat('sk_live_', left(b43, 24))",
        "concat('SG.', left(b43, 22), '.', b43)", "concat('eyJ', left(b43, 33), '.eyJ', b43, '.', left(b43, 40))")
    add(1, "host", ("postgres://{user}:", "https://{user}:", "redis://{user}:"), "left(b43, 14)", "concat(lower(name), left(d16, 2), 'pass')", "left(h32, 16)")
    add(1, "plain", ("Authorization: Bearer ",), "left(b43, 40)", "h40")
    add(1, "plain", ("Authorization: Basic ",), "base64(cast(concat(name, ':', left(b43, 9)) as binary))")
    for kind, lines, before in (("RSA ", "lines", ""), ("EC ", "left(lines, 90)", "key "), ("", "left(lines, 40)", "pem: ")):
        add(1, "plain", (before,), f"concat('-----BEGIN {kind}PRIVATE KEY-----\\n', {lines}, '\\n-----END {kind}PRIVATE KEY-----')")
    for before, value in (
            ("commit ", "h40"), ("sha256:", "h64"), ("md5 ", "h32"), ("revision ", "h40"), ("digest: ", "h64"), ("etag ", "h32"),
            ("uuid ", "concat_ws('-', left(h32, 8), substr(h32, 9, 4), substr(h32, 13, 4), substr(h32, 17, 4), right(h32, 12))"),
            ("", "d16"), ("card ", "d16"), ("order ", "d16"), ("", "concat(left(d16, 4), '-', substr(d16, 5, 4), '-', substr(d16, 9, 4), '-', right(d16, 4))"),
            ("", "concat(slug, '_', turn)"), ("file ", "concat(slug, '-', left(d16, 4))"), ("", "concat('IMG_', left(d16, 8), '_', right(d16, 6))"),
            ("see /", "concat('article/', slug, '/', turn)"), ("", "concat('get_user_', slug, '_v', turn)"),
            ("https://", "concat('www.', replace(slug, '_', '-'), turn, '.com/', left(slug, 6))"), ("file ", "concat(replace(slug, '_', '.'), turn, '.tar.gz')"),
            ("", "left(concat(d16, d16), 16)"), ("no ", "left(concat(d16, d16), 17)"), ("", "left(concat(d16, d16), 18)"), ("tel ", "left(concat(d16, d16), 20)"),
            ("id ", "left(concat(d16, d16), 16)"), ("", "left(concat(d16, d16), 19)"), ("", "concat('/usr/share/', slug, '/', left(d16, 3), '.png')"),
            ("version ", "concat('v', turn, '.', left(d16, 3), '.0-rc.1-', left(slug, 8))"), ("date ", "concat(left(d16, 4), '-01-', left(d16, 2), 'T10:', turn)"),
            ("", "concat(left(d16, 5), '.', right(d16, 10))"), ("", "concat(repeat(left(h32, 1), 18), turn)"),
            ("", "concat(replace(slug, '_', ''), replace(slug, '_', ''), turn)"), ("basic ", "concat(left(slug, 8), '101')"), ("Bearer ", "'<token_123>'")):
        add(0, "plain", (before,), value)
    add(0, "quoted", ('token = "', 'password: "', 'api_key="', 'secret = "'),
        "concat('your_token_here_', turn)", "concat('changeme', turn)", "concat('example', left(d16, 6))", "concat(repeat('x', 16), turn)",
        "'placeholder_value'", "concat(repeat('0', 12), turn)", "'default_password'", "concat(slug, '_name')", "concat('$', '{', upper(slug), '}')",
        "concat('<', slug, '>')", "left(words, 30)", "concat('enter your ', left(words, 12))", "concat('os.environ.get(', slug, ')')", "'********'")
    add(0, "plain", ("token: ", "password: ", "secret: "), "concat(left(slug, 9), 'ing')", "'required'", "concat('get_', left(slug, 8), '()')",
        "concat('$', upper(left(slug, 8)))", "'undefined'")
    makers = sorted({value for value, *_ in found})
    dressed = values.select("path", "words", "slug", F.array(*[F.expr(f"cast({maker} as string)") for maker in makers]).alias("made"))
    contexts = F.array(*[F.struct(F.lit(makers.index(value)).alias("at"), F.lit(before).alias("before"), F.lit(end).alias("end"), F.lit(label).alias("label"))
                         for value, before, end, label in found])
    ends = (F.when(F.col("end") == "quoted", F.concat(F.lit('" '), F.left("words", F.lit(30))))
            .when(F.col("end") == "host", F.concat(F.lit("@host."), F.left("slug", F.lit(4)), F.lit("/x "), F.left("words", F.lit(20))))
            .otherwise(F.concat(F.lit(" "), F.col("words"))))
    before = F.replace("before", F.lit("{user}"), F.left("slug", F.lit(5)))
    return written(dressed, "dressed").select("*", F.inline(contexts)).select(
        "path", F.get("made", "at").alias("candidate"), F.concat(F.right("words", F.lit(20)), F.lit(" "), before).alias("before"),
        ends.alias("after"), "label")


@dataclass
class SecretModel:
    """The forest, None without findings of both classes, and what its features have learnt."""

    forest: RandomForestClassificationModel | None
    learned: Learned


def fit_forest(findings: DataFrame) -> SecretModel:
    """The forest of labelled ``findings`` (candidate, before, after, path, label 0 / 1); other labels are left out.

    Findings without both classes teach nothing: there is no forest, and every candidate counts as a secret.
    """
    known = written(findings.where("label in (0, 1)").select("candidate", "before", "after", "path", F.col("label").cast("double")), "labelled")
    learned = learn(known)
    # One ordered file: bootstrap samples depend on where the rows lie. The sample is bounded.
    ordered = written(features(known, learned).coalesce(1).sortWithinPartitions(*FEATURES, "label"), "findings")
    if ordered.select("label").distinct().count() < 2:
        return SecretModel(None, learned)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="feature_vector", labelCol="label")
    fitted = forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="feature_vector").transform(ordered))
    # Read back, the model is free of its training summary, which holds on to the session and cannot be sent to tasks.
    path = scratch(findings.sparkSession, "forest")
    fitted.save(path)
    return SecretModel(RandomForestClassificationModel.load(path), learned)


def judge(found: DataFrame, model: SecretModel) -> DataFrame:
    """(path, text_key, ordinal, start, length, candidate, score) for each candidate of each different text and path."""
    once = found.groupBy("path", "text_key", "ordinal").agg(
        F.first("gap").alias("gap"), F.first("candidate").alias("candidate"), F.first("before").alias("before"), F.first("after").alias("after"))
    order = Window.partitionBy("path", "text_key").orderBy("ordinal")
    size = F.length("candidate")
    placed = once.withColumn("start", (F.sum(F.col("gap") + size).over(order) - size).cast("long"))
    marked = features(placed.select(
        "path", "text_key", "ordinal", "start", F.col("candidate").alias("value"), "candidate", "before", "after",
        F.col("path").alias("at_path")).withColumn("chars", size.cast("long")), model.learned)
    if model.forest is None:
        return marked.select("path", "text_key", "ordinal", "start", F.col("chars").alias("length"), F.col("value").alias("candidate"), F.lit(1.0).alias("score"))
    scored = model.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="feature_vector").transform(marked))
    return scored.select("path", "text_key", "ordinal", "start", F.col("chars").alias("length"), F.col("value").alias("candidate"),
                         vector_to_array("probability")[1].alias("score"))


def scan_secrets(docs: DataFrame, path: Column, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate of each document: doc_id, ordinal, start, length, candidate, score, is_secret.

    ``start`` counts characters from 0. ``findings`` are reviewed ones to learn from, by default
    ``labelled_findings``. Null and empty texts have no candidates, null paths are empty, a null doc_id stays null,
    repeated rows repeat their candidates, an empty table gives an empty result.
    """
    model = fit_forest(labelled_findings(docs, path) if findings is None else findings)
    found = written(candidates(docs, ["doc_id"], path), "candidates")
    judged = judge(found, model)
    return found.select("doc_id", "path", "text_key", "ordinal").join(judged, ["path", "text_key", "ordinal"]).select(
        "doc_id", "ordinal", "start", "length", "candidate", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redact_secrets(docs: DataFrame, path: Column, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``<SECRET>``; all rows and columns stay.

    Null and empty texts stay, an empty table gives an empty result. Only documents with candidates are shuffled. Where a text changes, ``n_chars`` (if there is one) is its new
    length and the control characters 1 and 2 become spaces.
    """
    model = fit_forest(labelled_findings(docs, path) if findings is None else findings)
    key, at, where, flag = (free_name(docs.columns, n) for n in ("text_key", "secret_at", "secret_path", "suspect"))
    # Written once with whether a text has candidates, so that it is searched once and not for each use.
    searched = written(docs.withColumn(flag, F.coalesce(F.col("text").rlike(_ANY), F.lit(False))).withColumn(
        where, F.when(F.col(flag), F.coalesce(path.cast("string"), F.lit("")))), "searched")
    suspects = searched.where(F.col(flag))
    judged = judge(candidates(suspects, [], F.col(where)), model)
    flagged = judged.where(F.col("score") >= THRESHOLD).groupBy("path", "text_key").agg(F.collect_list("ordinal").alias("secret_at"))
    marked = suspects.withColumn(key, F.sha2("text", 256))
    joined = marked.join(flagged.toDF(where, key, at), [where, key], "left")
    clean = F.array_join(F.transform(parts("text"), lambda part, i: F.when(
        F.array_contains(F.col(at), F.when(i % 2 == 1, ((i + 1) / 2).cast("int")).otherwise(0)), REDACTED).otherwise(part)), "")
    changed = F.col(at).isNotNull()
    text = F.when(changed, clean).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
                                if "n_chars" in docs.columns else {})
    redacted = joined.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
    return searched.where(~F.col(flag)).select(*docs.columns).unionByName(redacted)
