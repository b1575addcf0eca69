"""Typed relations of a snapshot's records, one for each kind.

Every relation keeps the raw text's keys, so that an absent field and a null one stay apart, and whether the record
could be parsed. A snapshot is parsed once: persist() keeps the typed relations for all rules.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import text as t
from recordloom.sources.snapshot import with_folders


class Records:
    """Relations over tree (sources.snapshot); optional inputs that no file tells are tables as well.

    tracked: (repo_id, path) of paths under version control; a repository without rows isn't a checkout.
    """

    def __init__(self, tree: DataFrame, tracked: DataFrame | None = None, keep: bool = True):
        self.keep, self._held = keep, []
        self.tree = self.kept(tree)
        self.tracked = tracked if tracked is not None else tree.sparkSession.createDataFrame([], "repo_id string, path string")

    @classmethod
    def of_files(cls, files: DataFrame, held: bool = False) -> Records:
        """Records over files (repo_id, path, content); folders, names and texts are made from them where they are asked for.

        held: keeps the files. Without it each relation reads those files alone that it needs, which are made again for each.
        """
        base = files.persist() if held else files
        out = cls(with_folders(base), keep=False)
        out.keep, out._held = True, [base] if held else []
        out.repos = base.select("repo_id").distinct()
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """df, held in memory or on disk once it is asked for, until release()."""
        if self.keep:
            self._held.append(df.persist())
        return df

    def release(self) -> None:
        """Lets go of all that is kept."""
        while self._held:
            self._held.pop().unpersist()

    def _json(self, files: DataFrame, schema: str) -> DataFrame:
        """repo_id, path, parent, name, text, keys (null if the file isn't a JSON object) and data."""
        return files.select("repo_id", "path", "parent", "name", "text", F.json_object_keys("text").alias("keys"), F.from_json("text", schema).alias("data"))

    @cached_property
    def files(self) -> DataFrame:
        return self.tree.where(~F.col("is_dir"))

    @cached_property
    def repos(self) -> DataFrame:
        return self.tree.select("repo_id").distinct()

    def below(self, top: str) -> DataFrame:
        """Files of a folder at the top, at any depth; those of others aren't read."""
        return self.files.where(F.col("top") == top)

    def one(self, path: str) -> DataFrame:
        return (self.below(path.split("/")[0]) if "/" in path else self.files).where(F.col("path") == path)

    @property
    def manifest_files(self) -> DataFrame:
        """Files of manifests, and dir_name."""
        found = self.below("work").where(F.col("path").rlike(rf"^work/(?:{'|'.join(model.STATUSES)})/[^/]+/work-item\.json\z"))
        return found.withColumn("dir_name", F.split_part("path", F.lit("/"), F.lit(3)))

    def _placed(self, own: DataFrame) -> DataFrame:
        """Manifests and what follows from their paths and data."""
        status = F.split_part("path", F.lit("/"), F.lit(2))
        order = F.struct(F.array_position(F.array(*map(F.lit, model.STATUSES)), status).alias("s"), F.col("path").alias("p"))
        told = {c: F.coalesce(f"data.{c}", F.lit("")) for c in ("id", "status")}
        places = {"parent": F.substring_index("path", "/", 3), "name": t.name("path"), "dir_status": status, "dir_name": F.split_part("path", F.lit("/"), F.lit(3)), "ord": order}
        return own.withColumns(places | told)

    @property
    def manifests(self) -> DataFrame:
        """Manifests with dir_status, dir_name and ord: the order of states, then of paths; read anew where it is asked for."""
        missing = F.sort_array(F.array_except(F.array(*map(F.lit, model.WORK_FIELDS)), "keys"))
        return self._placed(self._json(self.manifest_files, model.WORK_ITEM).withColumn("missing", missing))

    @cached_property
    def work(self) -> DataFrame:
        """manifests() without their texts and keys; missing fields are null where a manifest isn't a JSON object. Only what no path tells is kept."""
        return self._placed(self.kept(self.manifests.select("repo_id", "path", "missing", "data")))

    @cached_property
    def broken(self) -> DataFrame:
        """Repositories whose work can't be read, for a manifest or evidence record isn't a JSON object; and the first such path."""
        bad = self.work.where("missing is null").select("repo_id", "path").unionByName(self.evidence.where("keys is null").select("repo_id", "path"))
        return self.kept(bad.groupBy("repo_id").agg(F.min("path").alias("path")))

    @cached_property
    def items(self) -> DataFrame:
        """Manifests of repositories whose work can be read."""
        return self.work.join(self.broken.select("repo_id"), "repo_id", "left_anti")

    @cached_property
    def known_work(self) -> DataFrame:
        """repo_id, id and path of valid ids, at their first manifest; manifests that lack fields aren't among them."""
        sound = self.items.where((F.size("missing") == 0) & F.col("id").rlike(r"^[0-9]{3,}\z"))
        return sound.groupBy("repo_id", "id").agg(F.min_by("path", "ord").alias("path"))

    @cached_property
    def criteria(self) -> DataFrame:
        """One row for each criterion of a complete manifest, with pos from 0 and whether an earlier one has its id."""
        ids = F.transform("data.acceptance_criteria.id", lambda x: F.coalesce(x, F.lit("")))
        rows = self.items.where(F.size("missing") == 0).select("repo_id", "path", "parent", "ord", "status", F.col("id").alias("item"), F.col("data.provenance").alias("item_provenance"), ids.alias("ids"), F.posexplode("data.acceptance_criteria").alias("pos", "c"))
        rows = rows.withColumn("again", F.array_position("ids", F.coalesce("c.id", F.lit(""))) <= F.col("pos")).drop("ids")
        linked = F.coalesce("c.evidence", F.array().cast("array<string>"))
        return rows.select("*", F.coalesce("c.id", F.lit("")).alias("id"), F.col("c.state").alias("state"), F.col("c.provenance").alias("provenance"), linked.alias("linked")).drop("c")

    @cached_property
    def edges(self) -> DataFrame:
        """repo_id, path, src, dst, pos and src_ord of dependencies of all manifests."""
        return self.items.select("repo_id", "path", F.col("id").alias("src"), "status", F.col("ord").alias("src_ord"), F.posexplode("data.depends_on").alias("pos", "dst"))

    @cached_property
    def evidence(self) -> DataFrame:
        found = self.below("evidence").where(F.col("path").rlike(r"^evidence/runs/[^/]+\.json\z"))
        missing = F.sort_array(F.array_except(F.array(*map(F.lit, model.EVIDENCE_FIELDS)), "keys"))
        return self.kept(self._json(found, model.EVIDENCE).select("*", missing.alias("missing"), F.coalesce("data.id", F.lit("")).alias("id")))

    @cached_property
    def evidence_provenance(self) -> DataFrame:
        """repo_id, evidence and level: of equal ids the last path counts, and without a level evidence is concrete."""
        own = self.evidence.where("data.id is not null")
        return own.groupBy("repo_id", F.col("id").alias("evidence")).agg(F.max_by(F.coalesce("data.provenance", F.lit("concrete")), "path").alias("level"))

    @cached_property
    def findings(self) -> DataFrame:
        return self.kept(self._json(self.below("audits").where(F.col("path").rlike(r"^audits/findings/[^/]+\.json\z")), model.FINDING))

    @cached_property
    def invariants(self) -> DataFrame:
        return self._json(self.one("governance/invariants.json"), model.INVARIANTS)

    @cached_property
    def frozen(self) -> DataFrame:
        return self._json(self.one("governance/frozen-surface.json"), model.FROZEN)

    @cached_property
    def owners(self) -> DataFrame:
        return self.kept(self._json(self.one("governance/owners.json"), model.OWNERS))

    @cached_property
    def scopes(self) -> DataFrame:
        """repo_id, scope (id), paths and pos."""
        return self.kept(self.owners.select("repo_id", "path", F.posexplode("data.scopes").alias("pos", "s")).select("repo_id", "path", "pos", F.col("s.id").alias("scope"), F.col("s.paths").alias("paths"), F.col("s").isNull().alias("odd")))

    @cached_property
    def registry(self) -> DataFrame:
        return self.kept(self._json(self.one("audits/registry.json"), model.REGISTRY))

    @cached_property
    def audit_scopes(self) -> DataFrame:
        """repo_id, path (of the registry), pos and the entry's fields."""
        return self.registry.select("repo_id", "path", F.posexplode("data.scopes").alias("pos", "e")).select("repo_id", "path", "pos", F.col("e.path").alias("scope"), "e.contract", "e.last_reviewed", "e.next_review")

    @cached_property
    def contracts(self) -> DataFrame:
        """AGENTS.md files that no ignored part hides."""
        hidden = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, model.IGNORED_PARTS)))
        return self.files.where((F.col("name") == "AGENTS.md") & ~hidden).select("repo_id", "path", "parent")

    @cached_property
    def covered(self) -> DataFrame:
        """Folders of contracts that the registry names."""
        return self.audit_scopes.where("contract <> ''").select("repo_id", t.parent(t.normal_path("contract")).alias("parent")).distinct()

    def front(self, folder: str) -> DataFrame:
        """Markdown records of a folder, without its README, and their front matter (null if malformed)."""
        own = self.below(folder.split("/")[0]).where((F.col("parent") == folder) & F.col("path").endswith(".md") & (F.upper("name") != "README.MD"))
        return own.select("repo_id", "path", "name", "text", t.front_matter("text").alias("front"))

    @cached_property
    def decisions(self) -> DataFrame:
        return self.kept(self.front("decisions"))

    @cached_property
    def policies(self) -> DataFrame:
        return self.kept(self.front("governance/policies"))

    @cached_property
    def adopters(self) -> DataFrame:
        return self._json(self.one("governance/adopters.json"), model.ADOPTERS)

    def text_of(self, path: str, name: str) -> DataFrame:
        """repo_id and the trimmed text of a file under this name; repositories without it have no row."""
        return self.one(path).select("repo_id", F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+\z", "")).alias(name))
