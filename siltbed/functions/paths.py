"""Paths, names and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of content that is compressed already.
DENSE_EXTENSIONS = """
jpg jpeg png gif bmp tiff tif webp heic heif avif ico raw cr2 nef orf arw dng rw2 psd psb
mp4 avi mkv mov wmv flv webm m4v mpg mpeg 3gp 3g2 ts mts vob m2ts rm rmvb
mp3 aac flac ogg wma m4a wav opus aiff alac amr ape wv tta
zip zipx rar rar5 7z gz bz2 xz zst lz4 tar tgz lz lzma br sz cab arj ace lha lzh arc uha kgb z zz sit sitx brotli
iso dmg img bin nrg mdf mds ccd sub vmdk vdi vhd vhdx qcow2 qcow qed ova ovf xva wim esd squashfs cramfs
gho tib tibx vbk vib adi fbk sna
pdf docx xlsx pptx odt ods odp doc xls ppt epub mobi azw3 cbr cbz
exe dll so dylib jar war apk ipa deb rpm pkg msi app appx msix nupkg
""".split()
# File names of the same kind.
DENSE_NAMES = ["pagefile.sys", "hiberfil.sys", "swapfile.sys"]


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All before the last slash, '' for a path without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory, nearest first; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def toggle_leading_dot(path: Column) -> Column:
    return F.when(path == "", path).when(path.startswith("."), F.substring(path, F.lit(2), F.length(path))).otherwise(F.concat(F.lit("."), path))


def is_dense(path: Column) -> Column:
    """Whether a file is likely compressed already, by its extension or name."""
    name = F.lower(base_name(path))
    return F.regexp_extract(name, r"\.([^.]*)$", 1).isin(DENSE_EXTENSIONS) | name.isin(DENSE_NAMES)


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_cloud_id(value: Column) -> Column:
    """Not empty, not absolute, no drive letter, and no '..' segment by either slash."""
    up = F.exists(F.split(value, r"[/\\]"), lambda s: F.trim(s) == "..")
    return F.coalesce((value != "") & ~value.rlike(r"^[/\\]") & ~value.rlike("^[A-Za-z]:") & ~up, F.lit(False))


def safe_relative(path: Column) -> Column:
    """The lexically clean form of a path to restore, null where it is empty, absolute, on a drive, or leads out."""
    flat = slashed(path)
    step = lambda stack, part: (
        F.when((part == "") | (part == "."), stack)
        .when((part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != ".."), F.slice(stack, F.lit(1), F.size(stack) - 1))
        .otherwise(F.concat(stack, F.array(part)))
    )
    clean = F.aggregate(F.split(flat, "/"), F.array().cast("array<string>"), step)
    bad = (flat == "") | flat.startswith("/") | flat.rlike("^[A-Za-z]:") | (F.try_element_at(clean, F.lit(1)) == "..")
    return F.when(~F.coalesce(bad, F.coalesce(flat == "", F.lit(True)) | flat.startswith("/")), F.when(F.size(clean) == 0, ".").otherwise(F.array_join(clean, "/")))


def cloud_key(device: Column, source: Column) -> Column:
    """device/source, or the bare source without a device."""
    return F.when(F.coalesce(device, F.lit("")) == "", source).otherwise(F.concat(device, F.lit("/"), source))
