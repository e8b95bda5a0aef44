"""Tax-id expressions: cleaning, mod-11 checks, classes, fixed-width form."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from cargofile.functions.text import strip

# Mod-11 weights of the two public id schemes.
CNPJ_WEIGHTS = (
    (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
    (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
)
CPF_WEIGHTS = (
    (10, 9, 8, 7, 6, 5, 4, 3, 2),
    (11, 10, 9, 8, 7, 6, 5, 4, 3, 2),
)
ZERO_DOC = "0" * 14


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def document(c: Column) -> Column:
    """Digits of an id column; null when the cell is missing or holds no digit."""
    return F.nullif(digits_only(c), F.lit(""))


def _check_sql(d: str, weights: tuple[int, ...]) -> str:
    """Check digit as SQL: (11 - weighted sum mod 11), where 10 and 11 mean 0.

    Summed in doubles: exact at this size, and free of the overflow checks that integer
    arithmetic compiles to under ANSI mode, which keeps the generated code small.  ascii()
    of a missing position is 0, so no cast can fail.
    """
    total = " + ".join(f"ascii(substr({d}, {i + 1}, 1)) * {w}D" for i, w in enumerate(weights))
    return f"((11D - ({total} - {48 * sum(weights)}D) % 11D) % 11D % 10D)"


def _valid(d: Column | str, size: int, weights) -> Column:
    """mod-11 test of a column (given by name: one parsed expression) or of any Column."""
    test = lambda v: (
        f"coalesce(length({v}) = {size} AND replace({v}, left({v}, 1), '') <> ''"
        f" AND ascii(substr({v}, {size - 1}, 1)) = 48 + {_check_sql(v, weights[0])}"
        f" AND ascii(substr({v}, {size}, 1)) = 48 + {_check_sql(v, weights[1])}, false)")
    if isinstance(d, str):
        return F.expr(test(d))
    # A one-element array binds any expression to a name without repeating it.
    return F.exists(F.array(d), lambda v: _valid_column(v, size, weights))


def _valid_column(v: Column, size: int, weights) -> Column:
    code = lambda i: F.ascii(F.substring(v, i, 1))

    def digit(w):
        total = reduce(add, [code(i + 1) * float(x) for i, x in enumerate(w)])
        return (11.0 - (total - 48.0 * sum(w)) % 11.0) % 11.0 % 10.0

    ok = (
        (F.length(v) == size) & (F.replace(v, F.left(v, F.lit(1)), F.lit("")) != "")
        & (code(size - 1) == 48 + digit(weights[0])) & (code(size) == 48 + digit(weights[1])))
    return F.coalesce(ok, F.lit(False))


def is_valid_cnpj(digits: Column | str) -> Column:
    return _valid(digits, 14, CNPJ_WEIGHTS)


def is_valid_cpf(digits: Column | str) -> Column:
    return _valid(digits, 11, CPF_WEIGHTS)


def number(digits: Column) -> Column:
    """Digits of an id as a whole number, -1 where there are none or too many: the column that number_ok() reads."""
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def _sum_sql(n: str, skip: int, weights: tuple[int, ...]) -> str:
    """The weighted digit sum mod 11 of number ``n`` without its last ``skip`` digits.

    A digit is a quotient less ten times the next one, and -10 is 1 mod 11: so the quotients are summed, each by its own
    weight and the one to the right of it.  Whole numbers: texts are many times slower.
    """
    right = (*weights[::-1], 0)
    terms = [(k + skip, (w + right[k - 1] * (k > 0)) % 11) for k, w in enumerate(right[:-1])]
    return "(" + " + ".join(f"{n} div {10 ** k}L * {w}L" for k, w in terms if w) + ")"


def number_ok(digits: str, n: str, size: int) -> Column:
    """is_valid_cnpj() (size 14) or is_valid_cpf() (size 11) of a digits column whose number() is column ``n``."""
    weights = {14: CNPJ_WEIGHTS, 11: CPF_WEIGHTS}[size]
    first, second = (f"(11L - {_sum_sql(n, skip, w)} % 11L) % 11L % 10L" for skip, w in zip((2, 1), weights))
    # A multiple of 11...1 has one and the same digit all through.
    return F.expr(f"coalesce(length({digits}) = {size} AND {n} % {'1' * size}L <> 0L AND {first} = {n} div 10L % 10L"
                  f" AND {second} = {n} % 10L, false)")


def is_valid_for_field(name: str, accept_cpf: bool) -> Column:
    ok = is_valid_cnpj(name)
    return ok | is_valid_cpf(name) if accept_cpf else ok


def is_zero_filled_cpf(name: str) -> Column:
    """A 14-digit value that really is a person id with leading filler."""
    digits = F.col(name)
    hit = is_valid_cpf(f"right({name}, 11)") | (digits.startswith("000") & (F.right(digits, F.lit(11)) != "0" * 11))
    return F.coalesce((F.length(digits) == 14) & hit, F.lit(False))


def cpf_from_cnpj(name: str) -> Column:
    return F.when(is_zero_filled_cpf(name), F.right(F.col(name), F.lit(11)))


# Words that mark a company name.
COMPANY_WORDS = (
    "LTDA", "EIRELI", "SA", "S.A.", "S/A", "SOCIEDADE", "EMPRESA", "COMERCIO", "COMÉRCIO",
    "ME", "EPP",
)


def looks_like_person(name: Column) -> Column:
    words = "|".join(w.replace(".", r"\.") for w in COMPANY_WORDS)
    company = F.upper(strip(name)).rlike(rf"(?U)(^|\s)({words})(\s|$)")
    return F.coalesce(~company, F.lit(True))


def document_type(digits: Column) -> Column:
    n = F.length(digits)
    return F.when(n == 11, "CPF").when(n == 14, "CNPJ").otherwise("DESCONHECIDO")


def valid_type(name: str, n: str) -> Column:
    """CNPJ / CPF when the checksum holds, else null; ``n`` is the number() column of the digits."""
    return F.when(number_ok(name, n, 14), "CNPJ").when(number_ok(name, n, 11), "CPF")


def loose_id(c: Column) -> Column:
    """Keep 11 or 14 digits; other lengths are zero-filled or cut to 14; null gives zeros."""
    d = F.coalesce(digits_only(c), F.lit(""))
    return F.when(F.length(d).isin(11, 14), d).otherwise(F.left(F.lpad(d, F.greatest(F.length(d), F.lit(14)), F.lit("0")), F.lit(14)))


def fixed_document(digits: Column) -> Column:
    """14 positions: company id as is, person id blank-padded on the left."""
    return F.lpad(F.coalesce(digits, F.lit("")), 14, " ")


def document_class(name: str) -> Column:
    """Quality class of an id."""
    digits = F.col(name)
    return (
        F.when(digits.isNull() | (digits == ""), "vazio")
        .when(is_valid_cnpj(name), "cnpj_valido")
        .when(is_valid_cpf(name), "cpf_valido")
        .when(is_zero_filled_cpf(name), "cpf_com_zeros")
        .when(F.length(digits).isin(11, 14), "checksum_invalido")
        .otherwise("tamanho_invalido")
    )
