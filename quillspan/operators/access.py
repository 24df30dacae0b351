"""Label reach, label merges and the guards around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.retrieval import bounded
from quillspan.operators.security import AccessDenied


def clearance(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, clearance): the highest level of the user's roles. Users without a role have no row, hence no clearance."""
    return user_roles.join(roles.select(F.col("id").alias("role_id"), "priority_level"), "role_id").groupBy("user_id").agg(F.max("priority_level").alias("clearance"))


def label_reach(user_roles: DataFrame, roles: DataFrame, role_labels: DataFrame, user_groups: DataFrame, group_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """(user_id, label_id): labels granted to a role of the user, and those of the user's groups up to the user's clearance."""
    granted = user_roles.join(role_labels, "role_id").select("user_id", "label_id")
    grouped = user_groups.join(group_labels, "group_id").join(labels.select(F.col("id").alias("label_id"), F.col("priority_level").alias("level")), "label_id").join(clearance(user_roles, roles), "user_id")
    return granted.unionByName(grouped.where("level <= clearance").select("user_id", "label_id")).distinct()


def user_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    return user_roles.join(role_permissions, "role_id").select("user_id", "permission_code").distinct()


def visible_labels(labels: DataFrame, reach, manages: bool) -> DataFrame:
    """All labels for a manager, else those within reach; an empty reach shows none."""
    if manages:
        return labels
    return labels.where(F.col("id").isin([int(i) for i in reach])) if reach else labels.limit(0)


def offerable_labels(labels: DataFrame, ids=None) -> DataFrame:
    """Labels a document may be filed under: neither quarantine nor default, by name."""
    rows = labels if ids is None else labels.where(F.col("id").isin(list(ids)))
    return rows.where(~F.col("is_quarantine") & ~F.col("is_default"))


def synced_labels(documents: DataFrame, document_labels: DataFrame) -> DataFrame:
    """(document_id, labels) derived from the bridge: ascending, empty where there are none."""
    per = document_labels.groupBy("document_id").agg(F.sort_array(F.collect_set("label_id")).alias("l"))
    d = documents.select(F.col("id").alias("document_id")).join(per, "document_id", "left")
    return d.select("document_id", F.coalesce("l", F.array().cast("array<bigint>")).alias("label_ids"))


def check_merge(sources: set[int], target: int, reach: set[int], reserved: set[int]) -> None:
    """Refuses merges into a source, beyond reach, or of reserved labels."""
    if not sources or target in sources:
        raise ValueError("a label cannot be merged into itself")
    if beyond := (sources | {target}) - reach:
        raise AccessDenied(beyond)
    if sources & reserved:
        raise ValueError(f"reserved: {sorted(sources & reserved)}")


def _ids(values) -> F.Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in sorted(values)]).cast("array<bigint>")


def after_merge(column: str, sources, target: int):
    """A label set with sources replaced by the target; sets without a source stay as they are."""
    s = _ids(sources)
    return F.when(F.arrays_overlap(F.col(column), s), F.array_union(F.array_except(F.col(column), s), _ids([target]))).otherwise(F.col(column))


def merge_preview(documents: DataFrame, role_sets: DataFrame, sources, target: int) -> DataFrame:
    """One row: (documents_relabelled, visibility_widening).

    Widening counts documents that some role reads after the merge and did not
    before. Documents and roles are reduced to distinct label sets first, so
    the comparison is of sets with sets, not of every document with every role.
    A role without labels reads unlabelled documents only. ``role_sets`` has
    (role_id, label_ids).
    """
    s = _ids(sources)
    touched = documents.where(F.arrays_overlap(F.col("label_ids"), s))
    sets = documents.select(F.array_sort(F.array_distinct("label_ids")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("docs")).withColumn("d2", after_merge("d", sources, target))
    roles = role_sets.select(F.array_sort(F.array_distinct("label_ids")).alias("r")).distinct().withColumn("r2", after_merge("r", sources, target))
    sees = lambda d, r: (F.size(d) == 0) | F.arrays_overlap(F.col(d), F.col(r))
    # Only sets that hold a source or the target can change for any role.
    changing = sets.where(F.arrays_overlap(F.col("d"), F.array_union(s, _ids([target]))))
    wider = changing.join(bounded(roles), ~sees("d", "r") & sees("d2", "r2"), "left_semi").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("visibility_widening"))
    return touched.agg(F.count(F.lit(1)).alias("documents_relabelled")).crossJoin(wider)


def merge_apply(bridge: DataFrame, key: str, sources, target: int) -> DataFrame:
    """The bridge (key, label_id) after the merge: sources point to the target, nothing twice."""
    label = F.when(F.col("label_id").isin([int(i) for i in sources]), F.lit(int(target)).cast("bigint")).otherwise(F.col("label_id"))
    return bridge.select(key, label.alias("label_id")).distinct()


def last_admin_guard(roles: DataFrame, role_permissions: DataFrame, user_roles: DataFrame, needed=("users.manage", "roles.manage")) -> DataFrame:
    """(role_id, safe): whether the tenant's other roles that have users still hold every needed permission if this role went."""
    manned = user_roles.select("role_id").distinct()
    held = role_permissions.where(F.col("permission_code").isin(*needed)).join(manned, "role_id", "left_semi").join(roles.select(F.col("id").alias("role_id"), "tenant_id"), "role_id")
    other = held.select("tenant_id", F.col("role_id").alias("holder"), "permission_code")
    mine = roles.select(F.col("id").alias("role_id"), "tenant_id")
    left = mine.join(other, "tenant_id", "left").where(F.col("holder").isNull() | (F.col("holder") != F.col("role_id")))
    count = left.groupBy("role_id").agg(F.countDistinct("permission_code").alias("k"))
    return mine.join(count, "role_id", "left").select("role_id", (F.coalesce("k", F.lit(0)) == len(set(needed))).alias("safe"))


def replace_set(bridge: DataFrame, key: str, value: str, new: DataFrame) -> DataFrame:
    """The bridge with the values of every key in ``new`` replaced. ``new`` has (key, value); a NULL value empties the key."""
    kept = bridge.join(new.select(key).distinct(), key, "left_anti").select(key, value)
    return kept.unionByName(new.where(F.col(value).isNotNull()).select(key, value).distinct())


def granted_to_creator(role_labels: DataFrame, user_roles: DataFrame, creator: int, label_id: int) -> DataFrame:
    """Role grants after a user makes a label: every role of the creator may read it."""
    own = user_roles.where(F.col("user_id") == creator).select("role_id", F.lit(label_id).cast("bigint").alias("label_id"))
    return role_labels.select("role_id", "label_id").unionByName(own).distinct()


def revoked(role_labels: DataFrame, labels: DataFrame, system_roles: DataFrame) -> DataFrame:
    """Grants without those that give a reserved (quarantine) label to a role that is not a system role."""
    q = labels.where("is_quarantine").select(F.col("id").alias("label_id"))
    bad = role_labels.join(q, "label_id", "left_semi").join(system_roles.select(F.col("id").alias("role_id")), "role_id", "left_anti")
    return role_labels.join(bad, ["role_id", "label_id"], "left_anti")


#: Allowed changes of a tenant's state.
TRANSITIONS = {("active", "suspended"), ("suspended", "active"), ("suspended", "purging"), ("purging", "purged")}


def transition(current: str, wanted: str) -> str:
    if (current, wanted) not in TRANSITIONS:
        raise ValueError(f"{current} cannot become {wanted}")
    return wanted


def purge_preview(tables: dict[str, DataFrame], tenant_id: int) -> DataFrame:
    """(table, rows) that a purge of the tenant would delete, in the order of ``tables``."""
    out = None
    for name, df in tables.items():
        one = df.where(F.col("tenant_id") == tenant_id).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def without_tenant(df: DataFrame, tenant_id: int) -> DataFrame:
    """The table without the tenant's rows; rows without a tenant stay."""
    return df.where(~F.coalesce(F.col("tenant_id") == tenant_id, F.lit(False)))


def in_namespace(name: str, namespace: str):
    """Whether a label name lies in a namespace of '/'-separated segments: 'legal/eu' is in 'legal', 'legal-hold' is not."""
    parts, whole = F.split(F.trim(F.col(name)), "/"), F.split(F.lit(namespace), "/")
    return F.slice(parts, F.lit(1), F.size(whole)) == whole


def ensured_labels(tenants: DataFrame, labels: DataFrame, flag: str, name: str) -> DataFrame:
    """(tenant_id, name) of all labels that carry ``flag``, with one made up for every tenant that lacks it."""
    have = labels.where(F.col(flag)).select("tenant_id", "name")
    lack = tenants.select(F.col("id").alias("tenant_id")).join(have, "tenant_id", "left_anti").withColumn("name", F.lit(name))
    return have.unionByName(lack)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent added to ``old``; of several with one key any one is added."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def reserved_labels(labels: DataFrame, ids=None) -> DataFrame:
    """(tenant_id, label_id): the reserved (quarantine) labels, of those in ``ids`` (a DataFrame with label_id) if given."""
    found = labels.where("is_quarantine").select("tenant_id", F.col("id").alias("label_id"))
    return found if ids is None else found.join(ids.select("label_id").distinct(), "label_id", "left_semi")


def label_deletion(labels: DataFrame, document_labels: DataFrame) -> DataFrame:
    """(label_id, documents, deletable): a label that a document carries, or a reserved one, is not deleted, since a document that loses its last label is open to all."""
    used = document_labels.groupBy("label_id").agg(F.countDistinct("document_id").alias("documents"))
    l = labels.select(F.col("id").alias("label_id"), "is_quarantine").join(used, "label_id", "left")  # noqa: E741
    return l.select("label_id", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("documents").isNull() & ~F.coalesce("is_quarantine", F.lit(False))).alias("deletable"))


def without_label(labels: DataFrame, document_labels: DataFrame, label_id: int) -> DataFrame:
    """The labels without one; an error if it is reserved, in use or unknown."""
    row = label_deletion(labels.where(F.col("id") == label_id), document_labels.where(F.col("label_id") == label_id)).first()
    if row is None:
        raise KeyError(label_id)
    if not row["deletable"]:
        raise ValueError(f"label {label_id} is " + (f"carried by {row['documents']} documents" if row["documents"] else "reserved"))
    return labels.where(F.col("id") != label_id)


def renamed_label(labels: DataFrame, label_id: int, name: str) -> DataFrame:
    """The labels with one renamed; names are unique in a tenant up to case and outer blanks, and reserved labels keep theirs."""
    name = name.strip()
    if not name:
        raise ValueError("a label needs a name")
    row = labels.where(F.col("id") == label_id).select("tenant_id", "is_quarantine").first()
    if row is None:
        raise KeyError(label_id)
    if row["is_quarantine"]:
        raise ValueError(f"label {label_id} is reserved")
    if labels.where((F.col("tenant_id") == row["tenant_id"]) & (F.col("id") != label_id) & (F.lower(F.trim("name")) == name.lower())).limit(1).count():
        raise ValueError(f"there is a label {name!r}")
    return labels.withColumn("name", F.when(F.col("id") == label_id, F.lit(name)).otherwise(F.col("name")))


def with_default(labels: DataFrame, label_id: int) -> DataFrame:
    """The labels with one as the only default of its tenant."""
    tenant = labels.where(F.col("id") == label_id).select(F.col("tenant_id").alias("_tenant"))
    j = labels.join(F.broadcast(tenant), F.col("tenant_id") == F.col("_tenant"), "left")
    return j.withColumn("is_default", F.when(F.col("_tenant").isNull(), F.col("is_default")).otherwise(F.col("id") == label_id)).drop("_tenant")
