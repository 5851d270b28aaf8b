"""A store of findings, their citations and the investigations that made them.

Tables (Parquet below one folder, rewritten as a whole by a change; a store kept by people
is small): skills, findings, citations, investigations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import file_system

SCHEMAS = {
    "skills": "id long, name string, layer int, title string, github_issue long, description string",
    "findings": "id long, skill_id long, topic string, claim string, evidence string, source_url string, source_title string, source_type string, confidence string, tags string, notes string, date_found timestamp",
    "citations": "id long, finding_id long, authors string, title string, venue string, year int, doi string, url string, author_source string",
    "investigations": "id long, skill_id long, topic string, github_issue long, started_at timestamp, completed_at timestamp, queries_run long, findings_added long, status string, summary string",
}
#: Source types that cannot make a finding verified, and those without a web page (fixed values).
INFORMAL = ["blog_post", "forum_post", "other"]
LOCAL = ["benchmark", "empirical_test"]


class KnowledgeBase:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str) -> str:
        """The newest complete version of a table."""
        fs, p = file_system(self.spark, f"{self.folder}/{name}")
        versions = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()] if fs.exists(p) else []
        whole = [v for v in versions if fs.exists(file_system(self.spark, f"{self.folder}/{name}/{v}/_SUCCESS")[1])]
        return f"{self.folder}/{name}/{max(whole, default=-1)}"

    def table(self, name: str) -> DataFrame:
        path = self._path(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if path.endswith("/-1") else self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def _replace(self, name: str, rows: DataFrame) -> None:
        head, _, version = self._path(name).rpartition("/")
        rows.coalesce(1).write.parquet(f"{head}/{int(version) + 1}")

    def insert(self, table: str, /, **values) -> int:
        """Append one row; columns that are not given are null. Returns its id."""
        before = self.table(table)
        values["id"] = values.get("id") or (before.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([tuple(values.get(f.name) for f in before.schema)], before.schema)
        for column in ("date_found", "started_at"):
            if column in row.columns and values.get(column) is None:
                row = row.withColumn(column, F.current_timestamp())
        self._replace(table, before.unionByName(row))
        return values["id"]

    def _skill(self, name: str) -> int:
        found = self.table("skills").where(F.col("name") == name).first()
        if found is None:
            raise ValueError(f"no skill {name}")
        return found.id

    def add(self, skill: str, topic: str, claim: str, source_type: str = "other", confidence: str = "unverified", **more) -> int:
        return self.insert("findings", skill_id=self._skill(skill), topic=topic, claim=claim, source_type=source_type, confidence=confidence, **more)

    def cite(self, finding_id: int, authors: str, title: str, venue: str, year: int, author_source: str = "unverified", **more) -> int:
        return self.insert("citations", finding_id=int(finding_id), authors=authors, title=title, venue=venue, year=int(year), author_source=author_source, **more)

    def log_start(self, skill: str, topic: str, github_issue: int | None = None) -> int:
        return self.insert("investigations", skill_id=self._skill(skill), topic=topic, github_issue=github_issue, status="running", queries_run=0, findings_added=0)

    def log_end(self, investigation: int, queries_run: int, findings_added: int, summary: str) -> None:
        rows, this = self.table("investigations"), F.col("id") == int(investigation)
        now = {"completed_at": F.current_timestamp(), "status": F.lit("completed"), "queries_run": F.lit(int(queries_run)).cast("long"), "findings_added": F.lit(int(findings_added)).cast("long"), "summary": F.lit(summary)}
        self._replace("investigations", rows.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in now.items()}))

    def _named(self) -> DataFrame:
        skills = self.table("skills").select(F.col("id").alias("skill_id"), F.col("name").alias("skill"), "layer", F.col("title").alias("skill_title"))
        return self.table("findings").join(skills, "skill_id")

    def skill(self, name: str) -> DataFrame:
        return self._named().where(F.col("skill") == name).orderBy("topic", F.desc("date_found")).select("id", "topic", F.substring("claim", 1, 80).alias("claim"), "confidence", "source_type", "date_found")

    def topic(self, text: str) -> DataFrame:
        return self._named().where(F.lower("topic").contains(text.lower())).orderBy("layer", "skill_id").select("id", "skill", F.substring("claim", 1, 80).alias("claim"), "confidence", "source_url")

    def detail(self, finding_id: int) -> tuple[DataFrame, DataFrame]:
        """The finding, and its citations."""
        return self._named().where(F.col("id") == int(finding_id)), self.table("citations").where(F.col("finding_id") == int(finding_id))

    def investigations(self, limit: int = 20) -> DataFrame:
        skills = self.table("skills").select(F.col("id").alias("skill_id"), F.col("name").alias("skill"))
        return self.table("investigations").join(skills, "skill_id", "left").orderBy(F.desc("started_at")).limit(limit).select("id", "skill", "topic", "status", "findings_added", "started_at")

    def missing_urls(self) -> tuple[DataFrame, DataFrame]:
        """Findings without a source, counted by type, and one by one."""
        bare = self._named().where("source_url is null or source_url = ''")
        counts = bare.groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))
        return counts, bare.orderBy("source_type", "id").select("id", "skill", "topic", "source_type", F.substring("claim", 1, 60).alias("claim"))

    def verify(self) -> DataFrame:
        """check_name, n: findings and other rows that fail each quality check."""
        f, cites = self.table("findings"), self.table("citations")
        counted = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
        no_url = F.coalesce(F.col("source_url"), F.lit("")) == ""
        local = F.coalesce(F.col("source_type").isin(LOCAL), F.lit(False))
        key = ["source_url", "skill_id", "topic", F.substring("claim", 1, 50)]
        url = F.col("source_url")
        checks = [
            counted("inflated_confidence", f.where(F.col("source_type").isin(INFORMAL) & (F.col("confidence") == "verified"))),
            counted("unverified_authors", cites.where("author_source = 'unverified' or author_source is null")),
            # every finding that a later one repeats: all of a group but its last
            f.where(~no_url).groupBy(*key).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")).select(F.lit("near_duplicates").alias("check_name"), "n"),
            counted("encyclopedia_as_blog", f.where(url.contains("wikipedia.org") & (F.col("source_type") == "blog_post"))),
            counted("forum_miscategorised", f.where((url.contains("news.ycombinator.com") | url.contains("reddit.com")) & (F.col("source_type") != "forum_post"))),
            counted("no_url", f.where(no_url & ~local)),
            counted("no_local_path", f.where(no_url & local)),
            counted("stale_investigations", self.table("investigations").where("status = 'running' and started_at < current_timestamp() - interval 1 hour")),
            counted("uncited_papers", f.where("source_type = 'academic_paper'").join(cites.select(F.col("finding_id").alias("id")), "id", "left_anti")),
        ]
        out = checks[0]
        for c in checks[1:]:
            out = out.unionByName(c)
        return out
