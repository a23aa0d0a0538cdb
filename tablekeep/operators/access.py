"""Who may see, fill and delete which project.

Grants are kept per audience, a role with a department or any (``*``), never per
user: there are at most three for a project, however many users there are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles and visibilities.
ADMIN = "ADMIN"
AUDIT = "AUDIT"
DATA_OWNER = "DATA_OWNER"
PUBLIC = "PUBLIC"
DEPARTMENT = "DEPARTMENT"
ANY = "*"


def access_grants(projects: DataFrame, users: DataFrame, action: str = "view") -> DataFrame:
    """``project_id, role, department`` that may ``view`` or ``upload``.

    Administrators may do both everywhere, auditors only view. Data owners may use
    public projects and those whose owner is of their department; a project whose
    owner is unknown is open to no department.
    """
    roles = [ADMIN, AUDIT] if action == "view" else [ADMIN]
    everywhere = projects.select(
        "project_id",
        F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"),
        F.lit(ANY).alias("department"),
    )
    public = projects.filter(F.col("visibility") == PUBLIC).select(
        "project_id", F.lit(DATA_OWNER).alias("role"), F.lit(ANY).alias("department")
    )
    owners = users.select(F.col("employee_id").alias("owner_employee_id"), "department")
    own_department = (
        projects.filter(F.col("visibility") == DEPARTMENT)
        .join(owners, "owner_employee_id")
        .select("project_id", F.lit(DATA_OWNER).alias("role"), "department")
        .filter(F.col("department").isNotNull())
    )
    return everywhere.unionByName(public).unionByName(own_department)


def _audience(role: str, department: Column) -> Column:
    return F.concat_ws("|", F.col(role), department)


def _audiences(users: DataFrame) -> DataFrame:
    """One row per user and audience the user belongs to."""
    own = F.array(_audience("role", F.lit(ANY)), _audience("role", F.col("department")))
    return users.select("employee_id", F.explode(own).alias("audience"))


def visible_projects(users: DataFrame, grants: DataFrame) -> DataFrame:
    """The projects of the given users, as ``employee_id, project_id``."""
    granted = grants.select("project_id", _audience("role", F.col("department")).alias("audience"))
    return _audiences(users).join(granted, "audience").select("employee_id", "project_id")


def visible_project_counts(users: DataFrame, grants: DataFrame) -> DataFrame:
    """How many projects each user sees, without listing user-project pairs."""
    sizes = grants.groupBy(_audience("role", F.col("department")).alias("audience")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = _audiences(users).join(sizes, "audience", "left")
    return joined.groupBy("employee_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("projects")
    )


def own_project_counts(users: DataFrame, projects: DataFrame, grants: DataFrame) -> DataFrame:
    """How many of their own projects users see; a user without any has no row.

    Starts from the one owner of each project, so no list of all users and projects arises.
    """
    owners = projects.select("project_id", F.col("owner_employee_id").alias("employee_id")).join(users, "employee_id")
    own = F.array(_audience("role", F.lit(ANY)), _audience("role", F.col("department")))
    granted = grants.select("project_id", _audience("role", F.col("department")).alias("audience"))
    seen = owners.select("employee_id", "project_id", F.explode(own).alias("audience"))
    seen = seen.join(granted, ["project_id", "audience"], "left_semi").select("employee_id", "project_id").distinct()
    return seen.groupBy("employee_id").agg(F.count(F.lit(1)).alias("own_projects"))


def project_overview(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every project with its ``datasets_count``."""
    counts = datasets.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        projects.join(counts, "project_id", "left")
        .withColumn("datasets_count", F.coalesce("_n", F.lit(0)).cast("bigint"))
        .drop("_n")
    )


def deletable_projects(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    """Empty projects with their owner: administrators may delete any, data owners their own."""
    return projects.join(datasets.select("project_id").distinct(), "project_id", "left_anti")


def may_delete(role: Column | str, employee_id: Column | str, owner: Column | str) -> Column:
    """Whether a user of this role may delete an empty project of ``owner``."""
    role = F.col(role) if isinstance(role, str) else role
    employee_id = F.col(employee_id) if isinstance(employee_id, str) else employee_id
    owner = F.col(owner) if isinstance(owner, str) else owner
    return (role == ADMIN) | ((role == DATA_OWNER) & F.coalesce(employee_id == owner, F.lit(False)))


def owned_by(datasets: DataFrame, employees: str | DataFrame) -> DataFrame:
    """Datasets a user may preview, describe or profile: their own. ``employees`` is an id or a table with ``employee_id``."""
    if isinstance(employees, str):
        return datasets.filter(F.col("owner_employee_id") == employees)
    ids = employees.select(F.col("employee_id").alias("owner_employee_id")).distinct()
    return datasets.join(ids, "owner_employee_id", "left_semi")
