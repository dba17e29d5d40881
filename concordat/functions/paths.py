"""Path predicates and parts."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(F.regexp_replace(path, "/+$", "")), -1)


def parent_name(path: Column) -> Column:
    p = parts(F.regexp_replace(path, "/+$", ""))
    return F.nullif(F.try_element_at(p, F.lit(-2)), F.lit(""))


def is_safe(path: Column) -> Column:
    """No component climbs up."""
    return ~F.array_contains(parts(path), "..")


def is_within(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def is_relative(path: Column) -> Column:
    return ~path.startswith("/")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest to the root first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def sort_key(path: Column) -> Column:
    """Orders by component, so that ``a/b`` comes before ``a.txt``."""
    return parts(path)


def backup_path(path: Column, folder: str, suffix: str = "") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), basename(path), F.lit(suffix))


def trash_path(path: Column, folder: str) -> Column:
    return backup_path(path, folder)


def is_remote(location: Column) -> Column:
    return location.contains(":") & ~location.rlike("^[/.~]")


def location_parts(location: Column) -> Column:
    """struct(is_remote, user, host, path) of an address; local paths stay as written."""
    t = F.trim(location)
    remote = is_remote(t)
    front = F.substring_index(t, ":", 1)
    at = F.instr(front, "@") > 0
    user = F.when(remote & at, F.substring_index(front, "@", 1))
    host = F.when(remote, F.when(at, F.regexp_extract(front, "^[^@]*@(.*)$", 1)).otherwise(front)).otherwise("local")
    path = F.when(remote, F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1)).otherwise(t)
    return F.struct(remote.alias("is_remote"), user.alias("user"), host.alias("host"), path.alias("path"))


def expand(path: str) -> str:
    """A location made absolute on the driver; a leading ~ is the home folder."""
    if path.startswith("~") and "HOME" in os.environ:
        return path.replace("~", os.environ["HOME"], 1)
    return path if os.path.isabs(path) else os.path.join(os.getcwd(), path)


def default_trash() -> str:
    """The desktop trash of the driver's user."""
    home = os.environ.get("XDG_DATA_HOME") or os.path.join(os.environ.get("HOME", "/tmp"), ".local/share")
    return os.path.join(home, "Trash/files")


def unique_hosts(locations: Column) -> Column:
    """The distinct remote hosts of an array of locations, sorted; a user stays with its host."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(locations, is_remote), lambda x: F.substring_index(x, ":", 1))))
