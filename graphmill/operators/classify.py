"""Architectural roles of files, from paths, content, imported packages and graph shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import basename, extension, package_name, slashes

# Ordered rules, the first that fits wins. (category, confidence, what it looks at, pattern).
# Paths have their backslashes turned first. Rules that an earlier one covers are left out.
PATH_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("e2e", "high", "name", r"\.e2e\.(ts|tsx|js|jsx|mts|cts)$"),
    ("e2e", "high", "path", r"(^|/)e2e/"),
    ("test", "high", "path", r"(^|/)__tests__/"),
    ("test", "high", "path", r"(^|/)tests?/"),
    ("test", "high", "name", r"\.(test|spec)\.(ts|tsx|js|jsx|py)$"),
    ("test", "medium", "name", r"^test_.*\.py$"),
    ("example", "high", "path", r"(^|/)examples?/"),
    ("fixture", "high", "path", r"(^|/)__fixtures__/"),
    ("fixture", "high", "path", r"(^|/)fixtures?/"),
    ("archive", "high", "path", r"(^|/)archive/"),
    ("config", "high", "name", r"^(tsconfig|jest\.config|vitest\.config|webpack\.config|vite\.config|next\.config|babel\.config|eslint\.config|prettier\.config)\.(ts|js|mjs|json)$"),
    ("config", "high", "name", r"^\.env(\.\w+)?$"),
    ("config", "high", "name", r"^(package|composer|Cargo|go)\.(json|toml|mod)$"),
    ("config", "high", "name", r"^(Dockerfile|docker-compose\.ya?ml|Makefile|Procfile)$"),
    ("config", "medium", "path", r"/config/"),
    ("config", "medium", "name", r"^settings\.(py|ts|js)$"),
    ("style", "high", "name", r"\.(css|scss|sass|less|styl)$"),
    ("asset", "high", "name", r"\.(png|jpg|jpeg|gif|svg|ico|webp|mp4|webm|woff2?|ttf|eot)$"),
    ("migration", "high", "path", r"/migrations?/"),
    ("type", "high", "name", r"\.d\.ts$"),
    ("type", "medium", "path", r"/types?/"),
    ("type", "medium", "name", r"types?\.(ts|py)$"),
    ("type", "high", "path", r"(^|/)constants?/"),
    ("route", "high", "path", r"/app/api/"),
    ("route", "high", "path", r"/pages/api/"),
    ("route", "medium", "path", r"/routes?/"),
    ("route", "medium", "name", r"routes?\.(ts|js|py)$"),
    ("middleware", "high", "path", r"/middleware/"),
    ("middleware", "high", "name", r"^middleware\.(ts|js)$"),
    ("model", "high", "path", r"/models?/"),
    ("model", "high", "name", r"^schema\.(prisma|graphql|gql)$"),
    ("model", "medium", "name", r"models?\.(ts|js|py)$"),
    ("service", "high", "path", r"/services?/"),
    ("service", "medium", "name", r"service\.(ts|js|py)$"),
    ("controller", "high", "path", r"/controllers?/"),
    ("controller", "medium", "name", r"controller\.(ts|js|py)$"),
    ("utility", "high", "path", r"(^|/)hooks/"),
    ("utility", "high", "name", r"^use[A-Z][a-zA-Z0-9]*\.(ts|tsx)$"),
    ("component", "high", "path", r"(^|/)context/"),
    ("component", "high", "name", r"\.context\.(ts|tsx)$"),
    ("component", "high", "path", r"/components?/"),
    ("component", "medium", "name", r"\.(tsx|jsx)$"),
    ("utility", "high", "path", r"/(utils?|helpers?|lib)/"),
    ("utility", "medium", "name", r"(utils?|helpers?)\.(ts|js|py)$"),
    ("service", "high", "path", r"(^|/)store/"),
    ("entry", "high", "path", r"(^|/)bin/"),
    ("entry", "medium", "path", r"^(src/)?(main|index|app|server)\.(ts|tsx|js|jsx|py|go)$"),
    ("service", "high", "name", r"\.(store|slice|reducer|actions?)\.(ts|js)$"),
    ("service", "high", "path", r"(^|/)adapters?/"),
    ("service", "high", "name", r"\.(adapter|provider)\.(ts|js)$"),
    ("model", "high", "path", r"(^|/)repositor(y|ies)/"),
    ("model", "high", "name", r"\.repository\.(ts|js)$"),
    ("type", "high", "name", r"\.constants?\.(ts|js)$"),
    ("utility", "high", "path", r"(^|/)validators?/"),
    ("utility", "high", "name", r"\.(validator|schema)\.(ts|js)$"),
    ("utility", "high", "name", r"\.worker\.(ts|js)$"),
    ("test", "high", "path", r"(^|/)__mocks__/"),
    ("test", "high", "name", r"\.mock\.(ts|js)$"),
    ("config", "high", "path", r"(^|/)plugins?/"),
    ("middleware", "high", "path", r"(^|/)guards?/"),
    ("middleware", "high", "name", r"\.(guard|interceptor|pipe)\.(ts|js)$"),
    ("middleware", "high", "path", r"(^|/)interceptors?/"),
    ("middleware", "high", "path", r"(^|/)pipes?/"),
    ("config", "high", "path", r"^\.(github|claude|husky|vscode)/"),
    ("service", "high", "path", r"(^|/)analyzers?/"),
    ("service", "high", "path", r"(^|/)commands?/"),
    ("service", "high", "path", r"(^|/)ai/"),
    ("service", "high", "path", r"(^|/)db/"),
    ("service", "high", "path", r"(^|/)mcp/"),
    ("service", "high", "path", r"(^|/)tours?/"),
    ("service", "high", "path", r"(^|/)governance/"),
    ("service", "high", "path", r"(^|/)git/"),
    ("service", "high", "path", r"(^|/)runtime/"),
    ("utility", "high", "path", r"(^|/)scripts?/"),
)

# First path segments of framework sources.
LIBRARY_PACKAGES = (
    "fastapi", "starlette", "pydantic", "django", "flask", "sqlalchemy", "alembic", "uvicorn", "httpx", "aiohttp", "tornado", "celery", "express", "koa", "hapi",
)

# Ordered content rules (category, all of these, any of these).
CONTENT_RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("entry", (), (r"app\s*=\s*FastAPI\s*\(", r"app\s*=\s*Flask\s*\(", r"app\s*=\s*Starlette\s*\(")),
    ("entry", (), (r"(?m)^func\s+main\s*\(\s*\)\s*\{",)),
    ("route", (), (r"(?i)@(app|router)\.(get|post|put|delete|patch|head|options)\s*\(",)),
    ("route", (), (r"\.(GET|POST|PUT|DELETE|PATCH)\s*\(", r"mux\.HandleFunc?\s*\(", r"http\.HandleFunc\s*\(", r"e\.GET\s*\(|e\.POST\s*\(")),
    ("route", (), (r"\[Http(Get|Post|Put|Delete|Patch)\]",)),
    ("route", (), (r"(?m)^\s*@(Get|Post|Put|Delete|Patch|Head|Options)\s*\(",)),
    ("controller", (), (r"@Controller\s*\(",)),
    ("controller", (), (r"\[ApiController\]", r"\[Route\s*\(")),
    ("controller", (), (r"from\s+django\.(views|http)\s+import", r"class\s+\w+View\s*\(\s*\w*View\w*\s*\)")),
    ("service", (), (r"@Injectable\s*\(",)),
    ("service", (), (r"createSlice\s*\(", r"configureStore\s*\(", r"createStore\s*\(")),
    ("model", (), (r"@Entity\s*\(", r"extends\s+BaseEntity\b")),
    ("model", (), (r"from\s+sqlalchemy\s+import", r"from\s+sqlalchemy\.", r"from\s+databases\s+import", r"from\s+tortoise\s+import", r"from\s+django\.db\s+import.*models")),
    ("model", (), (r"\*gorm\.DB\b", r"\*sql\.DB\b", r"\*bun\.DB\b", r"\*sqlx\.DB\b", r"gorm\.Model\b", r'"gorm\.io/gorm"')),
    ("model", (), (r":\s*DbContext\b", r"class\s+\w+Context\s*:\s*\w*DbContext\b")),
    ("type", (r"from\s+pydantic\s+import",), (r"class\s+\w+\s*\(\s*\w*BaseModel\w*\s*\)",)),
    ("config", (), (r"@Module\s*\(",)),
)

# Layers of categories; what isn't listed is -1.
LAYERS = {
    "entry": 1, "route": 1, "presentation": 1, "controller": 2, "middleware": 2, "service": 3, "domain": 3, "model": 4, "repository": 4, "persistence": 5, "infrastructure": 5,
    "config": 0, "utility": 0, "test": -2,
}

# The category of files that mostly import packages of a role.
ROLE_CATEGORY = {
    "persistence": "service", "http": "service", "messaging": "service", "auth": "middleware", "validation": "model", "observability": "utility", "external-integration": "service",
}

# How specific a category is when graph heuristics tie.
SPECIFICITY = {"service": 5, "type": 4, "config": 3, "model": 3, "middleware": 3, "component": 3, "utility": 2, "unknown": 0}

# Prefixes of tooling entry points.
TOOLING_PREFIXES = ("bin/", "scripts/", "presentation/", "presentation-v2/", "docs/", "dev/", ".github/")

#: Packages by boundary role; callers bring their own table for more.
BOUNDARY_PACKAGES: Mapping[str, tuple[str, ...]] = {
    "persistence": ("pg", "mysql2", "sqlite3", "mongoose", "mongodb", "redis", "ioredis", "prisma", "@prisma/client", "typeorm", "sequelize", "knex", "sqlalchemy", "psycopg2", "asyncpg", "pymongo"),
    "http": ("express", "fastify", "koa", "axios", "node-fetch", "got", "fastapi", "flask", "django", "starlette", "requests", "httpx", "aiohttp"),
    "messaging": ("amqplib", "kafkajs", "bullmq", "nats", "mqtt", "celery", "pika", "kombu"),
    "auth": ("passport", "jsonwebtoken", "bcrypt", "next-auth", "jose", "authlib", "passlib"),
    "validation": ("zod", "joi", "yup", "ajv", "class-validator", "pydantic", "marshmallow"),
    "observability": ("winston", "pino", "debug", "prom-client", "@sentry/node", "structlog", "loguru"),
    "external-integration": ("stripe", "openai", "twilio", "aws-sdk", "boto3", "@octokit/rest"),
}


def chain(conditions: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    if not conditions:
        return F.lit(otherwise)
    out = F.when(conditions[0][0], F.lit(conditions[0][1]))
    for condition, value in conditions[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def table_of(values: Mapping[str, object], key: Column, otherwise: object) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(otherwise))


def _by_path(path: Column, index: int, library: str, none: str) -> Column:
    """The value at `index` of the first path rule that fits.

    Neighbouring rules of one value are one condition, and their patterns one
    pattern: generated code stays small enough to be compiled whole.
    """
    plain = slashes(path)
    name = basename(plain)
    conditions: list[tuple[Column, object]] = [(F.substring_index(plain, "/", 1).isin(*LIBRARY_PACKAGES), library)]
    for value, rules in groupby(PATH_RULES, key=lambda r: r[index]):
        group = list(rules)
        some = None
        for what, column in (("path", plain), ("name", name)):
            patterns = [p for _, _, w, p in group if w == what]
            if patterns:
                fits = column.rlike("|".join(f"(?:{p})" for p in patterns))
                some = fits if some is None else some | fits
        conditions.append((some, value))
    return chain(conditions, none)


def category_of(path: Column) -> Column:
    return _by_path(path, 0, "libSource", "unknown")


def confidence_of(path: Column) -> Column:
    return _by_path(path, 1, "high", "low")


def classify_path(files: DataFrame) -> DataFrame:
    """files (path, ...) with category and confidence; unknown and low where no rule fits."""
    return files.withColumn("category", category_of(F.col("path"))).withColumn("confidence", confidence_of(F.col("path")))


def content_category(content: Column) -> Column:
    def fits(rule: tuple[str, tuple[str, ...], tuple[str, ...]]) -> Column:
        some = F.lit(False)
        for pattern in rule[2]:
            some = some | content.rlike(pattern)
        for pattern in rule[1]:
            some = some & content.rlike(pattern)
        return some

    return chain([(fits(rule), rule[0]) for rule in CONTENT_RULES])


def classify_content(classified: DataFrame) -> DataFrame:
    """Unknown rows of path, content, category, confidence by their content; an empty or null content says nothing."""
    found = F.when((F.col("category") == "unknown") & (F.coalesce("content", F.lit("")) != ""), content_category(F.col("content")))
    return classified.withColumn("found", found).withColumn("confidence", F.when(F.col("found").isNotNull(), "high").otherwise(F.col("confidence"))).withColumn("category", F.coalesce("found", "category")).drop("found")


def boundary_lookup(spark, packages: Mapping[str, tuple[str, ...]] = BOUNDARY_PACKAGES) -> DataFrame:
    """package, role: a dimension whose size is the parameter's."""
    return spark.createDataFrame([(p, role) for role, names in packages.items() for p in names], "package string, role string")


def read_boundary_lookup(spark, path: str) -> DataFrame:
    """package, role from a two-column CSV file, for a larger table than the default."""
    return spark.read.csv(path, schema="package string, role string")


def with_roles(imports: DataFrame, lookup: DataFrame) -> DataFrame:
    """source, role, edge_ord of imports (source, target, edge_ord) whose package has a role."""
    return imports.withColumn("package", package_name(F.col("target"))).join(lookup, "package").select("source", "role", "edge_ord")


def boundary_roles(roles: DataFrame) -> DataFrame:
    """source, role, n of roles (source, role): all roles that a file imports most often."""
    counts = roles.groupBy("source", "role").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.rank().over(Window.partitionBy("source").orderBy(F.desc("n")))).where("k = 1").select("source", "role", "n")


def classify_boundary(classified: DataFrame, roles: DataFrame) -> DataFrame:
    """Unknown rows (key, category, confidence) by their most imported role; the first imported one on ties."""
    counts = roles.groupBy("source", "role").agg(F.count(F.lit(1)).alias("n"), F.min("edge_ord").alias("first"))
    best = counts.groupBy(F.col("source").alias("key")).agg(F.min(F.struct(-F.col("n"), "first", "role"))["role"].alias("role"))
    joined = classified.join(best, "key", "left")
    found = F.when(F.col("category") == "unknown", table_of(ROLE_CATEGORY, F.col("role"), None))
    return joined.withColumn("found", found).select(
        *[c for c in classified.columns if c not in ("category", "confidence")],
        F.coalesce("found", "category").alias("category"),
        F.when(F.col("found").isNotNull(), "low").otherwise(F.col("confidence")).alias("confidence"),
    )


def graph_candidates(files: DataFrame, edges: DataFrame, packages: DataFrame | None = None, least_fan_in: int = 3, majority: float = 0.6) -> DataFrame:
    """key, heuristic, category, confidence, specificity: what each of six heuristics says of unknown files.

    files: key, path, category; edges: s, t, type_only; packages: key, package of
    external imports.
    """
    degree = (
        files.select("key", "category")
        .join(edges.groupBy(F.col("t").alias("key")).agg(F.count(F.lit(1)).alias("fan_in"), F.bool_and("type_only").alias("all_types"), F.min("s").alias("one_source")), "key", "left")
        .join(edges.groupBy(F.col("s").alias("key")).agg(F.count(F.lit(1)).alias("fan_out")), "key", "left")
        .na.fill(0, ["fan_in", "fan_out"])
    )
    unknown = degree.where("category = 'unknown'")
    known = files.select(F.col("key"), F.col("category").alias("other"), F.col("path"))
    h1 = unknown.where((F.col("fan_in") >= least_fan_in) & (F.col("fan_out") == 0)).select("key", F.lit("h1").alias("heuristic"), F.lit("utility").alias("found"), F.lit("medium").alias("sure"))
    h3 = unknown.where("fan_in > 0 and all_types").select("key", F.lit("h3").alias("heuristic"), F.lit("type").alias("found"), F.lit("medium").alias("sure"))
    importers = edges.join(known.withColumnRenamed("key", "s"), "s", "left")
    is_test = F.coalesce((F.col("other") == "test") | F.col("path").rlike(r"\.test\.|\.spec\."), F.lit(False))
    all_tests = importers.groupBy(F.col("t").alias("key")).agg(F.bool_and(is_test).alias("only"))
    h4 = unknown.join(all_tests.where("only"), "key").select("key", F.lit("h4").alias("heuristic"), F.lit("utility").alias("found"), F.lit("low").alias("sure"))
    around = edges.select(F.col("t").alias("key"), F.col("s").alias("near")).unionByName(edges.select(F.col("s").alias("key"), F.col("t").alias("near"))).distinct()
    votes = around.join(known.select(F.col("key").alias("near"), "other"), "near").where("other <> 'unknown'").groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("key").agg(F.min(F.struct(-F.col("n"), "other")).alias("best"), F.sum("n").alias("all"))
    h5 = unknown.join(most, "key").where(-F.col("best.col1") >= majority * F.col("all")).select("key", F.lit("h5").alias("heuristic"), F.col("best.other").alias("found"), F.lit("low").alias("sure"))
    h6 = (
        unknown.where("fan_in = 1 and fan_out = 0")
        .join(known.select(F.col("key").alias("one_source"), "other").where("other = 'entry'"), "one_source")
        .select("key", F.lit("h6").alias("heuristic"), F.lit("config").alias("found"), F.lit("low").alias("sure"))
    )
    out = h1.unionByName(h3).unionByName(h4).unionByName(h5).unionByName(h6)
    if packages is not None:
        sole = packages.distinct().groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").select("key").distinct()
        out = out.unionByName(unknown.join(sole, "key").select("key", F.lit("h2").alias("heuristic"), F.lit("service").alias("found"), F.lit("medium").alias("sure")))
    return out.select("key", "heuristic", F.col("found").alias("category"), F.col("sure").alias("confidence"), table_of(SPECIFICITY, F.col("found"), 0).alias("specificity"))


def classify_graph(candidates: DataFrame) -> DataFrame:
    """key, category, confidence, heuristic: the surest candidate, then the most specific, then the first heuristic."""
    order = F.struct(F.when(F.col("confidence") == "medium", 0).otherwise(1), -F.col("specificity"), "heuristic", "category", "confidence")
    best = candidates.groupBy("key").agg(F.min(order).alias("b"))
    return best.select("key", "b.category", "b.confidence", "b.heuristic")


def layer_of(category: Column) -> Column:
    return table_of(LAYERS, category, -1)


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """s, t, source_layer, target_layer, direction of edges against the layers (node, layer).

    Unknown (-1) and exempt (0) layers are passed over, a test may skip layers.
    """
    a, b = F.col("source_layer"), F.col("target_layer")
    placed = edges.join(layers.select(F.col("node").alias("s"), F.col("layer").alias("source_layer")), "s").join(layers.select(F.col("node").alias("t"), F.col("layer").alias("target_layer")), "t")
    direction = F.when(a.isin(-1, 0) | b.isin(-1, 0), None).when(b < a, "backward").when((b - a >= 2) & (a != -2), "skip-layer")
    return placed.withColumn("direction", direction).where("direction is not null").select("s", "t", "source_layer", "target_layer", "direction")


def entry_surface(path: Column) -> Column:
    tooling = F.lit(False)
    for prefix in TOOLING_PREFIXES:
        tooling = tooling | slashes(path).startswith(prefix)
    return F.when(tooling, "tooling").otherwise("runtime")


def classification_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count(F.lit(1)).alias("files"))


# Names of an application's entry file.
APP_ENTRIES = ("main.py", "app.py", "server.py", "wsgi.py", "asgi.py", "main.ts", "main.js", "app.ts", "app.js", "server.ts", "server.js", "index.ts", "index.js")


def repo_character(classified: DataFrame, unknown_rate: float = 0.4, least_files: int = 10) -> DataFrame:
    """files, unknown, rate, is_library: one row; a library is mostly unknown and has no shallow entry file."""
    depth = F.size(F.filter(F.split(slashes(F.col("path")), "/"), lambda s: s != ""))
    shallow = (depth <= 3) & basename(slashes(F.col("path"))).isin(*APP_ENTRIES)
    counts = classified.agg(
        F.count_if(F.col("category") != "test").alias("files"), F.count_if(F.col("category") == "unknown").alias("unknown"), F.coalesce(F.bool_or(shallow), F.lit(False)).alias("has_entry")
    )
    rate = F.when(F.col("files") > 0, F.col("unknown") / F.col("files")).otherwise(0.0)
    return counts.select("files", "unknown", rate.alias("rate"), ((F.col("files") >= least_files) & (rate > unknown_rate) & ~F.col("has_entry")).alias("is_library"))


# Extensions by language.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".py": "Python", ".go": "Go", ".java": "Java", ".kt": "Kotlin",
    ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".swift": "Swift",
}


def primary_language(files: DataFrame) -> DataFrame:
    """language, files: the language of most files, first by name on ties; Unknown for none."""
    named = files.select(table_of(LANGUAGES, extension(F.col("path")), None).alias("language")).where("language is not null")
    best = named.groupBy("language").agg(F.count(F.lit(1)).alias("files")).agg(F.min(F.struct(-F.col("files"), "language")).alias("b"))
    return best.select(F.coalesce("b.language", F.lit("Unknown")).alias("language"), F.coalesce(-F.col("b.col1"), F.lit(0)).alias("files"))
