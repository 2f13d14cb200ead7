"""TeX commands in titles."""

from __future__ import annotations

import re

# Commands and the characters that stand for them in titles.
TITLE_SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η",
    "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π",
    "rho": "ρ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ",
    "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ",
    "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "times": "×", "cdot": "·", "pm": "±", "mp": "∓", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒",
    "Leftrightarrow": "⇔", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "in": "∈", "notin": "∉",
    "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩", "oplus": "⊕", "otimes": "⊗",
    "propto": "∝", "dots": "…", "ldots": "…", "cdots": "⋯", "partial": "∂", "nabla": "∇", "sum": "Σ", "prod": "∏",
    "int": "∫", "sqrt": "√", "degree": "°",
}

_COMMAND = re.compile(r"(?<![A-Za-z])\\([A-Za-z]+)")


def title_text(text: str) -> str:
    r"""A title without ``\(``, ``\)``, ``\[``, ``\]``, known commands as characters, white space collapsed."""
    text = re.sub(r"\\[()\[\]]", " ", text)
    return " ".join(_COMMAND.sub(lambda m: TITLE_SYMBOLS.get(m[1], m[0]), text).split())
