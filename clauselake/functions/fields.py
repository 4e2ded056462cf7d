"""What a form field asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of fields in the order in which they are tried, with the patterns of each.
PATTERNS = (
    ("card_cvv", r"\bcvv\b|\bcvc\b|\bcsc\b|security.?code|card.?code|安全碼|信用卡驗證"),
    ("card_expiry", r"cc-exp|exp.?(date|month|year|iry)|valid.?thru|有效期|到期日"),
    ("credit_card", r"cc-number|card.?(number|num|no)\b|creditcard|信用卡|卡號|卡片號碼"),
    ("national_id", r"hkid|身份證|身分證|identity.?card|\bid.?(card|number|no)\b|national.?id|\bssn\b|social.?security|passport|護照|\bnric\b|aadhaar"),
    ("bank_account", r"\biban\b|\bswift\b|routing.?(number|no)|sort.?code|bank.?acc|account.?(number|no)\b|銀行帳|銀行戶口|戶口號碼|帳戶號碼"),
    ("dob", r"\bbday\b|birth.?date|date.?of.?birth|\bdob\b|出生日期|生日"),
    ("address", r"street.?address|address.?line|postal.?code|\bzip\b|\baddress\b|地址|郵遞區號|郵編"),
    ("full_name", r"given.?name|family.?name|full.?name|first.?name|last.?name|\bsurname\b|姓名|名字|\bname\b"),
    ("phone", r"\btel\b|phone|mobile|電話|手機|流動電話"),
    ("email", r"e-?mail|電郵|郵箱|電子郵件"),
)
#: Kinds that are personal, and those that are sensitive by themselves.
PERSONAL = ("credit_card", "card_cvv", "card_expiry", "national_id", "bank_account", "dob", "full_name", "address", "phone", "email")
SENSITIVE = ("password", "credit_card", "card_cvv", "national_id", "bank_account")
ATTRIBUTES = ("type", "name", "id", "autocomplete", "placeholder", "label")


def kind(field: dict[str, Column]) -> Column:
    """The kind of a field, given its six ATTRIBUTES; nulls are empty."""
    of = {a: F.coalesce(field[a], F.lit("")) for a in ATTRIBUTES}
    words = F.lower(F.concat_ws(" ", *of.values()))
    out = F.when(of["type"] == "password", "password")
    for name, pattern in PATTERNS:
        out = out.when(words.rlike(pattern), name)
    return out.when(of["type"] == "tel", "phone").when(of["type"] == "email", "email").otherwise("other")
