"""Secret scans: known patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov models over one alphabet are trained from labelled samples, one of random strings and
one of ordinary identifiers. A long token whose mean log-likelihood ratio per character is over a threshold
is a span of its own kind, beside the spans of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prefix_sums

# The kinds in their order, their patterns, the group whose length counts, and its least length.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: The method's own kind, its candidates and its threshold in nats per character.
MARKOV = "markov"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.5
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Added to each character's count, and the weight of the characters' own shares in a pair's estimate.
SMOOTHING = 0.5
BACKOFF = 8.0
MASK = "[SECRET]"

# Ordinary identifiers and words, the samples of the second model.
ORDINARY = """
account_balance activeSessionCount addEventListener application_version arrayBufferView background-color
baseDirectoryPath batch_size_per_device booleanExpression border-bottom-width buildConfiguration cacheInvalidationPolicy
calculateTotalAmount categoryDescription changePasswordRequest character_encoding checkAvailability clientConnectionPool
closeResourceQuietly collectionIterator columnDefinition command_line_arguments communication completedSuccessfully
configurationManager connection_timeout_seconds considerations constructorArgument containerDefinition convertToString
coordinateTransformation createTemporaryDirectory currentUserPreferences customer_address_line databaseMigrationVersion
dateTimeFormatter defaultErrorHandler dependencyInjection description deserializationError development_environment
directoryListing distributedComputing documentBuilderFactory downloadAttachment elementsByClassName emailNotification
enableExperimentalFeatures encryptionAlgorithm environment_variables errorMessageTemplate evaluateExpression
eventDispatcher exceptionHandlerMethod executionContext expected_response_code extractInformation fileSystemWatcher
findAllByCustomerName forEachRemaining fragmentManager functionParameter generateReport getElementById
getOrCreateInstance graphicalUserInterface handleIncomingRequest hashCodeBuilder headerNavigationMenu
http://localhost/index /home/user/projects/readme identifierGenerator implementationDetails importantInformation
indexOutOfBoundsException initializeComponent inputStreamReader internationalization interpolationSearch
invoice_line_number isAuthenticated itemDescriptionLabel javaVirtualMachine keyboardInterrupt languageTranslation
lastModifiedTimestamp legalConsiderations libraryDependencies listOfIntegers loadBalancerAddress localizedMessage
loggingConfiguration machineLearningModel mainActivityLayout mathematical_constant maximumConnections
memoryAllocation messageQueueListener metadataRepository microservice-architecture minimumOrderQuantity
monthly_subscription_fee navigationController nearestNeighbourSearch network_interface_card notification-settings
numberOfOccurrences objectRelationalMapping observationsPerSecond onClickListener openTransaction operatingSystem
organizationalStructure original_file_name outputDirectory packageManagement pageNumberIndicator parallelExecution
parseConfigurationFile performanceMeasurement permission_denied persistentStorage postalCodeValidator
preconditionFailed previousTransaction processingInstruction productCatalogueService propertyPlaceholder
publishedDocuments quantityInStock queryOptimizer randomAccessFile readOnlyCollection recommendationEngine
recursive_descent_parser referenceImplementation registrationForm relationshipManager remove_duplicate_rows
repositoryFactory representation requestDispatcher resourceNotFound response_content_type retryOnFailure
satisfactionSurvey scheduledExecutor searchResultsPage secondaryIndex sequenceGenerator serverConfiguration
session_expiration_time setDefaultLocale shippingAddress shoppingCartItems singleResponsibility softwareDevelopment
sortedByLastName source_code_management specification standardDeviation startApplication statisticalAnalysis
stringManipulation subscriptionService supportedLanguages synchronizationLock systemAdministrator tableOfContents
temperature_measurement templateEngine testDrivenDevelopment thirdPartyLibraries threadPoolExecutor
totalNumberOfPages transactionManager transformation-matrix translationUnit unauthorizedAccess understanding
uniqueConstraintViolation unitOfMeasurement update_or_create userInterfaceElements utilityFunctions
validationErrorMessage variableDeclaration verificationEmail version_control_system virtualEnvironment
warehouse_location_code weatherForecast webApplicationContext whitespaceTokenizer windowSizeChanged workflowDefinition
entwicklungsumgebung zusammenarbeit geschwindigkeit verantwortlichkeit wissenschaftlichen unterschiedlichen
einschliesslich datenverarbeitung gesellschaft wirtschaftlichkeit developpement renseignements gouvernementales
habituellement consequences environnement etablissement particulierement administraciones conocimientos
responsabilidad establecimiento desarrolladores inmediatamente organizaciones caracteristicas
"""


#: Digests among the samples, and how often each ordinary identifier is joined to another one.
RANDOMS = 4000
JOINED = 9


def samples(spark: SparkSession, randoms: int = RANDOMS) -> DataFrame:
    """Labelled samples (token, random): ordinary identifiers, alone and joined in pairs, and digests of counters in hexadecimal and base 64."""
    words, n = F.split(F.lit(" ".join(ORDINARY.split())), " "), len(ORDINARY.split())
    pair = lambda j: F.transform(words, lambda w, i: F.when(j == 0, w).otherwise(F.concat(w, F.lit("_"), F.get(words, (i + 7 * j) % n))))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(JOINED)), pair))
    ordinary = spark.range(1).select(F.explode(every).alias("token"), F.lit(False).alias("random"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    made = spark.range(randoms).select(F.when(F.col("id") % 3 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("token"), F.lit(True).alias("random"))
    return ordinary.unionByName(made)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each character pair, as one row-major list over ALPHABET.

    labelled: (token, random). Characters outside ALPHABET are ignored. The counts are aggregated in Spark; only
    the table of at most len(ALPHABET) ** 2 pairs comes to the driver.
    """
    import math

    n = len(ALPHABET)
    chars = F.filter(F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda i: i >= 0)
    tokens = labelled.filter(F.col("token").isNotNull() & F.col("random").isNotNull()).select("random", chars.alias("c"))
    pairs = F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get("c", i + 1).alias("b")))
    counted = tokens.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b").count().collect()
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in counted}

    def rows(kind: bool) -> list[list[float]]:
        """Probabilities of each next character, backed off to its share among all."""
        table = [[counts.get((kind, a, b), 0) for b in range(n)] for a in range(n)]
        share = [sum(row[b] for row in table) + SMOOTHING for b in range(n)]
        whole = sum(share)
        return [[(c + BACKOFF * share[b] / whole) / (sum(row) + BACKOFF) for b, c in enumerate(row)] for row in table]

    return [math.log(p / q) for ps, qs in zip(rows(True), rows(False), strict=True) for p, q in zip(ps, qs, strict=True)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs; 0 for fewer than two known characters."""
    n = len(ALPHABET)
    cells = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")
    chars = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda i: i >= 0)

    def mean(c: Column) -> Column:
        ratios = F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, i: F.get(cells, a * n + F.get(c, i + 1)))
        return F.aggregate(ratios, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(c) - 1, F.lit(1))

    return F.transform(F.array(chars), mean)[0]


def spans_of(text: Column, kind: int, name: str, pattern: str, found: Column, kept: Column) -> Column:
    """(start, end, kind, name) of a pattern's matches whose flag in kept is true.

    found: all matches in order; kept: a flag for each. The text between them gives the starts: match i starts after
    the first i + 1 pieces and the first i matches. Code points, end exclusive.
    """
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
    between = F.transform(F.array(lengths(F.split(text, pattern, -1))), lambda p: F.slice(p, 1, F.size(p) - 1))[0]

    def of(size: Column) -> Column:
        ends = prefix_sums(F.zip_with(between, size, lambda p, m: p + m))
        each = F.zip_with(ends, size, lambda e, m: F.struct((e - m).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), F.lit(name).alias("name")))
        # the flags are evaluated once, as one side of the zip, and not for every match
        return F.filter(F.zip_with(each, kept, lambda s, k: F.when(k, s)), lambda s: s.isNotNull())

    none = F.lit([]).cast("array<struct<start:int,end:int,kind:int,name:string>>")
    return F.when(F.size(found) > 0, F.transform(F.array(lengths(found)), of)[0]).otherwise(none)


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Add base and spans, arrays of (start, end, kind, name) by start, then kind, and __text (null: empty).

    base has the spans of the patterns, spans also those of the Markov models. All other columns of docs stay; own
    columns named base, spans or __text are replaced. The work grows with a text's length, however many matches it has.
    """
    df = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    text = F.col("__text")
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    at_least = lambda found, least: F.transform(found, lambda g: F.char_length(g) >= least)
    for k, (name, p, group, least) in enumerate(KINDS):
        df = df.withColumn(f"__s{k}", spans_of(text, k, name, p, every(p, 0), at_least(every(p, group), least)))
    random = F.transform(every(CANDIDATE, 0), lambda t: likelihood_ratio(t, model) > threshold)
    df = df.withColumn("__own", spans_of(text, len(KINDS), MARKOV, CANDIDATE, every(CANDIDATE, 0), random))
    df = df.withColumn("base", F.array_sort(F.concat(*[F.col(f"__s{k}") for k in range(len(KINDS))])))
    df = df.withColumn("spans", F.array_sort(F.concat("base", "__own")))
    return df.drop("__own", *[f"__s{k}" for k in range(len(KINDS))])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running_max(values: Column) -> Column:
    """Greatest of each value and all before it, of an array of ints, in blocks of about the square root of its length."""
    def of(a: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / block).cast("int") - 1, F.lit(0))), lambda j: F.slice(a, j * block + 1, block))
        before = lambda tops: F.transform(tops, lambda _, j: F.array_max(F.slice(tops, 1, j)))
        tops = _bind(F.transform(blocks, lambda b: F.array_max(b)), before)
        return F.flatten(F.zip_with(blocks, tops, lambda b, t: F.transform(b, lambda _, i: F.greatest(t, F.array_max(F.slice(b, 1, i + 1))))))

    return _bind(values, of)


def merged(spans: Column) -> Column:
    """(start, end) of the unions of overlapping spans, which are sorted by start."""
    def of(s: Column) -> Column:
        def islands(top: Column) -> Column:
            opens = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(top, i - 1)), i)), lambda i: i.isNotNull())
            last = lambda o, j: F.coalesce(F.get(o, j + 1) - 1, F.size(s) - 1)
            return _bind(opens, lambda o: F.transform(o, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.get(top, last(o, j)).alias("end"))))

        return _bind(running_max(F.transform(s, lambda x: x["end"])), islands)

    return _bind(spans, of)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each of the spans, disjoint and ascending, replaced by the mask.

    The text is cut into chunks of about the square root of its length, as a substring of the whole is found by
    walking there from its start.
    """
    def of(t: Column) -> Column:
        n = F.char_length(t)
        size = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        chunks = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda j: F.substring(t, j * size + 1, size))

        def between(both: Column) -> Column:
            c, m = both["c"], both["m"]

            def piece(a: Column, b: Column) -> Column:
                first = F.floor(a / size).cast("int")
                near = F.array_join(F.slice(c, first + 1, F.floor(b / size).cast("int") - first + 1), "")
                return F.substring(near, a - first * size + 1, b - a)

            each = F.transform(m, lambda s, i: F.concat(piece(F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"]), s["start"]), F.lit(mask)))
            return F.concat(F.array_join(each, ""), piece(F.element_at(m, -1)["end"], n))

        return _bind(F.struct(chunks.alias("c"), spans.alias("m")), between)

    return _bind(text, of)


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """Replace every span, overlapping ones merged, by the mask; n_chars, where there is one, follows. Null texts stay.

    All other columns and rows stay, whatever their names; repeated rows and an empty table are no special cases.
    """
    # whole rows are set aside, so that no column of theirs can clash with what the scan adds
    df = scan(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model, threshold)
    changed = F.size("spans") > 0
    df = df.withColumn("text", F.when(changed, masked(F.col("__text"), merged(F.col("spans")), mask)).otherwise(F.col("text")))
    kept = {c: F.col(f"__row.{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return df.select(*[kept[c].alias(c) for c in docs.columns])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Find secrets in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(samples(spark)))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _oracle_sql() -> str:
    """DuckDB SQL for op10_secrets: the same patterns, samples and models, written as joins."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    kinds = [(k, name, p, group, least) for k, (name, p, group, least) in enumerate(KINDS)] + [(len(KINDS), MARKOV, CANDIDATE, 0, 0)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, {quote(name)} AS name, {least} AS least, regexp_extract_all(t, {quote(p)}) AS m, regexp_extract_all(t, {quote(p)}, {group}) AS g, regexp_split_to_array(t, {quote(p)}) AS between FROM d"
        for k, name, p, group, least in kinds
    )
    size = lambda items: f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"
    chars = "list_filter(list_transform(string_split(token, ''), lambda c: strpos(" + quote(ALPHABET) + ", c) - 1), lambda i: i >= 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT doc_id, kind, name, least, m, g, between, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (
  SELECT doc_id, kind, name, least, m[i] AS token, length(g[i]) AS measured, {size('between[1:i]')} + {size('m[1:i-1]')} AS a
  FROM e),
ordinary AS (SELECT string_split({quote(' '.join(ORDINARY.split()))}, ' ') AS l),
samples AS (
  SELECT CASE WHEN j = 0 THEN l[i + 1] ELSE l[i + 1] || '_' || l[(i + 7 * j) % len(l) + 1] END AS token, false AS random FROM ordinary, range({len(ORDINARY.split())}) a(i), range({JOINED + 1}) b(j)
  UNION ALL SELECT CASE WHEN i % 3 = 0 THEN sha256('sample ' || i) ELSE to_base64(unhex(sha256('sample ' || i))) END, true FROM range({RANDOMS}) r(i)),
c AS (SELECT random, {chars} AS c FROM samples),
n AS (SELECT random, c[j] AS a, c[j + 1] AS b, count(*) AS n FROM (SELECT random, c, unnest(range(1, len(c))) AS j FROM c) GROUP BY ALL),
letters AS (SELECT unnest(range({len(ALPHABET)})) AS x),
grid AS (SELECT r.random, l.x AS a, m.x AS b FROM (SELECT DISTINCT random FROM samples) r, letters l, letters m),
full_n AS (SELECT g.random, g.a, g.b, coalesce(n.n, 0) AS n FROM grid g LEFT JOIN n USING (random, a, b)),
share AS (SELECT random, b, sum(n) + {SMOOTHING} AS share FROM full_n GROUP BY 1, 2),
whole AS (SELECT random, sum(share) AS whole FROM share GROUP BY 1),
rows_n AS (SELECT random, a, sum(n) AS total FROM full_n GROUP BY 1, 2),
p AS (SELECT random, a, b, (n + {BACKOFF} * CAST(share AS DOUBLE) / whole) / (total + {BACKOFF}) AS p FROM full_n JOIN share USING (random, b) JOIN whole USING (random) JOIN rows_n USING (random, a)),
ratio AS (SELECT x.a, x.b, ln(x.p / y.p) AS r FROM p x JOIN p y ON x.a = y.a AND x.b = y.b WHERE x.random AND NOT y.random),
tokens AS (SELECT token, {chars} AS c FROM (SELECT DISTINCT token FROM s WHERE name = {quote(MARKOV)})),
scored AS (
  SELECT token, sum(r) / greatest(count(*), 1) AS r FROM (SELECT token, c[j] AS a, c[j + 1] AS b FROM (SELECT token, c, unnest(range(1, len(c))) AS j FROM tokens)) JOIN ratio USING (a, b) GROUP BY token),
kept AS (
  SELECT s.doc_id, s.kind, s.name, CAST(a AS BIGINT) AS a, CAST(a + length(s.token) AS BIGINT) AS z FROM s LEFT JOIN scored ON scored.token = s.token
  WHERE CASE WHEN name = {quote(MARKOV)} THEN r > {THRESHOLD} ELSE measured >= least END)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name, *_ in kinds[:-1])},
       sha256(coalesce(string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (kind < {len(KINDS)}), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL = _oracle_sql()
