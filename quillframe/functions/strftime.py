"""From strftime directives to Spark's date patterns."""

from quillframe.errors import UserError

# Directive, pattern when reading (one or two digits), pattern when writing.
DIRECTIVES = {
    "Y": ("yyyy", "yyyy"), "m": ("M", "MM"), "d": ("d", "dd"), "H": ("H", "HH"), "M": ("m", "mm"), "S": ("s", "ss"),
    "y": ("yy", "yy"), "j": ("D", "DDD"), "I": ("h", "hh"), "p": ("a", "a"), "A": ("EEEE", "EEEE"), "a": ("EEE", "EEE"),
    "B": ("MMMM", "MMMM"), "b": ("MMM", "MMM"), "h": ("MMM", "MMM"),
}
SHORT = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M"}


def spark_pattern(text: str, reading: bool = False) -> str:
    """The Spark pattern of a strftime format; unknown directives are an error."""
    for k, v in SHORT.items():
        text = text.replace(f"%{k}", v)
    out, literal, i = [], "", 0

    def flush():
        nonlocal literal
        if literal:
            quoted = literal.replace("'", "''")
            out.append(f"'{quoted}'" if any(c.isalpha() or c in "'[]{}#" for c in literal) else literal)
            literal = ""

    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            code = text[i + 1]
            i += 2
            if code == "%":
                literal += "%"
                continue
            if code not in DIRECTIVES:
                raise UserError(f"unsupported format directive %{code} in {text!r}")
            flush()
            out.append(DIRECTIVES[code][0 if reading else 1])
        else:
            literal += text[i]
            i += 1
    flush()
    return "".join(out)
