"""Rules on names and log lines: cleaning, de-duplication, sensitivity. Driver forms and, where queries need them, column forms."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path, PureWindowsPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from shadowset.models import Sensitivity

# Characters that names of files may not have, on any common system.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'

# Name patterns of sensitive columns.
HIGH = [
    "ssn", "social_security", "national_id", "tax_id", "tin", "credit_card", "card_number", "card_num", "cc_number", "passport", "driver_license", "drivers_license", "license_number",
    "bank_account", "account_number", "iban", "routing_number",
]
LOW_EXACT = ["name", "email"]
LOW_ANYWHERE = [
    "e_mail", "email_address", "phone_number", "telephone", "first_name", "last_name", "full_name", "person_name", "customer_name", "employee_name", "contact_name", "user_name",
    "street_address", "home_address", "zip_code", "postal_code", "date_of_birth", "birth_date", "ip_address", "ip_addr",
]
LOW_SEGMENT = ["email", "phone", "mobile", "cell", "surname", "address", "street", "zip", "zipcode", "dob", "birthday"]

# What log lines may not show.
ABSOLUTE_PATH = r"""(?:[A-Za-z]:\\[^\s,;"']+|/(?:home|Users|tmp|var|etc|opt|mnt|data)/[^\s,;"']+)"""
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
EMAIL_MASK = "[REDACTED_EMAIL]"

# Folders that are never data folders.
BLOCKED_FOLDERS = ["/etc", "/usr", "/bin", "/sbin", "/var", "/tmp", "/proc", "/sys", "/dev", "C:/Windows", "C:/Program Files", "C:/Program Files (x86)"]


def _clean(name: str, empty: str) -> str:
    return re.sub(UNSAFE, "_", name).strip("_") or empty


def table_name(name: str) -> str:
    return _clean(name.replace("..", ""), "table")


safe_filename = table_name


def column_name(name: str) -> str:
    return _clean(name, "column")


def table_name_column(name: Column) -> Column:
    whole = F.regexp_replace(F.replace(name, F.lit(".."), F.lit("")), UNSAFE, "_")
    return F.coalesce(F.nullif(F.btrim(whole, F.lit("_")), F.lit("")), F.lit("table"))


def column_name_column(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, UNSAFE, "_"), F.lit("_")), F.lit("")), F.lit("column"))


def distinct_columns(names: Iterable[str]) -> list[str]:
    """Cleaned names, later ones of a kind with _1, _2, ... after them."""
    out: list[str] = []
    for name in map(column_name, names):
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def distinct_table(name: str, taken: Iterable[str]) -> str:
    """name, or name_2, name_3, ... if it is taken."""
    new, k = name, 1
    while new in taken:
        k += 1
        new = f"{name}_{k}"
    return new


def sensitivity(name: str) -> Sensitivity:
    """The sensitivity that a column's name suggests. High patterns match anywhere, so that e.g. ``rating`` holds ``tin``."""
    low = name.lower().replace(" ", "_")
    if any(p in low for p in HIGH):
        return Sensitivity.HIGH
    if low in LOW_EXACT or any(p in low for p in LOW_ANYWHERE) or not set(LOW_SEGMENT).isdisjoint(low.split("_")):
        return Sensitivity.LOW
    return Sensitivity.NONE


def sensitivity_column(name: Column) -> Column:
    low = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    anywhere = lambda patterns: low.rlike("|".join(map(re.escape, patterns)))
    segment = F.arrays_overlap(F.split(low, "_"), F.array(*map(F.lit, LOW_SEGMENT)))
    return F.when(anywhere(HIGH), "high").when(low.isin(LOW_EXACT) | anywhere(LOW_ANYWHERE) | segment, "low").otherwise("none")


def scrub(line: str) -> str:
    """A log line with absolute paths cut to their last part and e-mail addresses masked."""
    line = re.sub(ABSOLUTE_PATH, lambda m: PureWindowsPath(m[0]).name if "\\" in m[0] else m[0].rstrip("/").rsplit("/", 1)[-1], line)
    return re.sub(EMAIL, EMAIL_MASK, line)


def scrub_column(line: Column) -> Column:
    unix = F.regexp_replace(line, r"""/(?:home|Users|tmp|var|etc|opt|mnt|data)/(?:[^\s,;"'/]*/)*([^\s,;"'/]+)/*""", "$1")
    both = F.regexp_replace(unix, r"""[A-Za-z]:\\(?:[^\s,;"'\\]*\\)*([^\s,;"'\\]+)\\*""", "$1")
    return F.regexp_replace(both, EMAIL, EMAIL_MASK.replace("[", r"[").replace("]", r"]"))


class ScrubbingFilter:
    """A logging filter that scrubs messages and their string arguments."""

    def filter(self, record) -> bool:
        if isinstance(record.msg, str):
            record.msg = scrub(record.msg)
        if isinstance(record.args, tuple):
            record.args = tuple(scrub(a) if isinstance(a, str) else a for a in record.args)
        return True


def configure_logging(folder: str = "logs", level: str = "INFO") -> None:
    """Console and rotating file logs, scrubbed. A second call changes nothing."""
    import logging
    from logging.handlers import RotatingFileHandler

    root = logging.getLogger("shadowset")
    if root.handlers:
        return
    Path(folder).mkdir(parents=True, exist_ok=True)
    for handler in (logging.StreamHandler(), RotatingFileHandler(Path(folder) / "shadowset.log", maxBytes=10 << 20, backupCount=3)):
        handler.addFilter(ScrubbingFilter())
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)
    root.setLevel(level)


def data_folder(path: str) -> Path | None:
    """The folder as an absolute path; None for an empty one; ValueError for links, roots and system folders."""
    if not path or not path.strip():
        return None
    given = Path(path)
    if given.is_symlink():
        raise ValueError("a symbolic link is no data folder")
    whole = given.resolve()
    plain = str(whole).replace("\\", "/").rstrip("/").lower()
    if not plain or re.fullmatch("[a-z]:", plain):
        raise ValueError("a root is no data folder")
    if any(plain == b.lower() or plain.startswith(b.lower() + "/") for b in BLOCKED_FOLDERS):
        raise ValueError(f"a system folder is no data folder: {whole}")
    return whole
