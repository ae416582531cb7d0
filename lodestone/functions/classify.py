"""Format, document type, media type and acceptance of files, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from . import tables as t


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def file_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """The lower-cased last extension; none for a leading or trailing dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def upload_suffix(name: Column) -> Column:
    """As :func:`suffix`, but Terraform's two-part one stays whole."""
    return F.when(F.lower(name).endswith(".tf.json"), F.lit(".tf.json")).otherwise(suffix(name))


def format_of(path: Column) -> Column:
    name = file_name(path)
    by_name = _lookup(name, t.FORMAT_OF_NAME)
    by_suffix = _lookup(suffix(name), t.FORMAT_OF_EXTENSION)
    return F.when(F.lower(name).endswith(".tf.json"), F.lit("terraform")).otherwise(F.coalesce(by_name, by_suffix, F.lit("prose")))


def _first_known(parts: Column) -> Column:
    """Type of the first part that names one."""
    known = F.filter(F.transform(parts, lambda p: _lookup(p, t.TYPE_OF_FOLDER)), lambda x: x.isNotNull())
    return F.try_element_at(known, F.lit(1))


def doc_type_of(path: Column, *hints: Column) -> Column:
    """File name prefix, then path components, then hints in order, then what the format says."""
    name = file_name(path)
    prefix = reduce(lambda rest, kv: F.when(name.startswith(kv[0]), F.lit(kv[1])).otherwise(rest), reversed(list(t.TYPE_OF_PREFIX.items())), F.lit(None).cast("string"))
    hinted = [_first_known(F.split(F.replace(F.lower(h), F.lit("\\"), F.lit("/")), "/")) for h in hints]
    fallback = F.when(format_of(path).isin(*t.CODE_FORMATS), F.lit("code")).otherwise(F.lit("generic"))
    return F.coalesce(prefix, _first_known(F.split(F.lower(path), "/")), *hinted, fallback)


def mime_of(fmt: Column) -> Column:
    return F.coalesce(_lookup(fmt, t.MIME_OF_FORMAT), F.lit(t.OTHER_MIME))


def upload_status(name: Column, size_bytes: Column, chat: bool = False, settings: Settings = DEFAULTS) -> Column:
    """``ok``, or why an upload is turned away."""
    limit = (settings.max_chat_upload_mb if chat else settings.max_upload_mb) * 1024 * 1024
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("no filename"))
        .when(~upload_suffix(name).isin(*t.UPLOAD_EXTENSIONS), F.lit("unsupported type"))
        .when(F.coalesce(size_bytes, F.lit(0)) == 0, F.lit("empty file"))
        .when(size_bytes > limit, F.lit("too large"))
        .otherwise(F.lit("ok"))
    )


def listed(name: Column, mime: Column) -> Column:
    """Whether a drive listing's file is taken: native types that can be exported, else by extension."""
    return F.when(mime.startswith(t.NATIVE_PREFIX), mime.isin(*t.EXPORTS)).otherwise(suffix(name).isin(*t.LISTING_EXTENSIONS))


def exported_name(name: Column, mime: Column) -> Column:
    new = _lookup(mime, {m: e for m, (_, e) in t.EXPORTS.items()})
    base = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    return F.when(new.isNotNull(), F.concat(base, new)).otherwise(name)


def exported_mime(mime: Column) -> Column:
    return F.coalesce(_lookup(mime, {m: x for m, (x, _) in t.EXPORTS.items()}), mime)


def is_refusal(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike("(?i)" + "|".join(t.REFUSALS))


def filename_matches(expected: Column, *places: Column) -> Column:
    """Case-blind containment of an expected file name in any of the places."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(p, F.lit(""))), F.lower(expected)) for p in places])


def folder_path(parents: Column, names: Column) -> Column:
    """'/' and the parents' names (their ids where unknown); ``names``: map of id to name."""
    shown = F.transform(parents, lambda p: F.coalesce(F.try_element_at(names, p), p))
    return F.when(F.coalesce(F.size(parents), F.lit(0)) <= 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(shown, "/")))


def flat_permissions(permissions: Column) -> Column:
    """Entries of ``array<struct<type, emailAddress, displayName>>`` as plain strings."""
    filled = lambda c: F.coalesce(c, F.lit(""))

    def one(p: Column) -> Column:
        mail, shown = filled(p["emailAddress"]), filled(p["displayName"])
        return (
            F.when(p["type"].isin("user", "group") & (mail != ""), mail)
            .when(p["type"] == "domain", F.concat(F.lit("domain:"), F.when(shown != "", shown).otherwise(mail)))
            .when(p["type"] == "anyone", F.lit("anyone"))
        )

    return F.filter(F.transform(F.coalesce(permissions, F.array()), one), lambda x: x.isNotNull())


def top_category(path: Column, root: Column) -> Column:
    """The first folder below a corpus's root, which names the category of its files."""
    return F.substring_index(F.ltrim(F.replace(path, root, F.lit("")), F.lit("/")), "/", 1)


def iso(at: Column) -> Column:
    """A UTC timestamp in ISO form."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
