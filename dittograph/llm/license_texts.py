"""Texts of common licences and of the notices by which files refer to them.

Whole texts lie in ``licence_files``, each under its licence's name, as their publishers
word and wrap them.
"""

import re
from collections.abc import Iterator
from pathlib import Path

_FILES = Path(__file__).parent / "licence_files"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        f"substantial portions of the Software.\n\n{_AS_IS}",
    ),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holders>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"Copyright (C) <year> <holders>\n\n{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0-notice", "Released under CC0 1.0."),
    ("BSD-3-Clause-notice", "Licensed under the BSD 3-Clause License."),
    ("proprietary-notice", "All content is proprietary and confidential."),
]


def _variants(name: str, text: str) -> Iterator[tuple[str, str]]:
    """``text`` in the forms in which it stands alone: with its appendix and without, with a title and points of either kind."""
    texts = [text]
    if "END OF TERMS AND CONDITIONS" in text:
        texts.append(text.partition("END OF TERMS AND CONDITIONS")[0])
        texts.append(texts[1] + "END OF TERMS AND CONDITIONS")
    if name == "CC-BY-4.0":  # with the publisher's frame and without
        texts.append(text[text.index("Creative Commons Attribution 4.0 International Public License") :].rpartition("=====")[0] or text)
    if name.startswith("BSD"):
        texts.append(re.sub(r"(?m)^\d\. ", "* ", text))
        clauses = name[4]
        texts += [f"{title}\n\n{x}" for title in (f"BSD {clauses}-Clause License", f"The BSD {clauses}-Clause License", "BSD License") for x in texts[:]]
    if name == "Unlicense":
        texts.append(f"The Unlicense\n\n{text}")
    return ((name, x) for x in texts)


def _whole() -> Iterator[tuple[str, str]]:
    for path in sorted(_FILES.glob("*.txt")):
        name, text = path.stem.removesuffix("-Regents"), path.read_text("utf-8")
        yield from _variants(name, text)
        if path.stem == "BSD-3-Clause":
            yield from _variants("BSD-2-Clause", re.sub(r"(?ms)^3\. .*?\n\n", "", text))


KNOWN += _whole()
