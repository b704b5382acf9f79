"""Chemistry behind a small protocol, so that nothing here needs a toolkit to import.

``TextChemistry`` treats a structure as a string: containment is ``in``, fingerprints
are hashed trigrams, identities are normalised spellings. It serves tests and text data.
``ToolkitChemistry`` uses RDKit where it is installed.
"""

from __future__ import annotations

import re
import warnings
import zlib
from typing import Protocol

from ..errors import QueryError


class Chemistry(Protocol):
    bits: int

    def check_pattern(self, pattern: str) -> str: ...
    def check_molecule(self, molecule: str) -> str: ...
    def canonical(self, molecule: str) -> str: ...
    def pattern_bits(self, molecule: str, query: bool = False) -> list[int]: ...
    def similarity_bits(self, molecule: str) -> list[int]: ...
    def identity(self, molecule: str) -> str | None: ...
    def parent(self, molecule: str) -> str | None: ...
    def contains(self, molecule: str, pattern: str) -> bool: ...


class TextChemistry:
    """Strings as structures. The screen is exact in one direction: a substring's trigrams are the text's."""

    bits = 512

    def _need(self, text: str) -> str:
        if not text.strip():
            raise QueryError("an empty structure matches nothing")
        return text

    check_pattern = check_molecule = _need

    def canonical(self, molecule: str) -> str:
        return " ".join(molecule.split())

    def pattern_bits(self, molecule: str, query: bool = False) -> list[int]:
        return sorted({zlib.crc32(molecule[i : i + 3].encode()) % self.bits for i in range(len(molecule) - 2)})

    similarity_bits = pattern_bits

    def identity(self, molecule: str) -> str | None:
        return self.canonical(molecule).lower() or None

    def parent(self, molecule: str) -> str | None:
        """Identity without what follows the first separator."""
        return re.split(r"[.;|]", self.identity(molecule) or "")[0].strip() or None

    def contains(self, molecule: str, pattern: str) -> bool:
        return pattern in molecule


class ToolkitChemistry:
    """RDKit: pattern fingerprints for the screen, Morgan (radius 2, 2048 bits) for similarity."""

    bits = 2048

    def __init__(self):
        from rdkit import Chem  # optional
        from rdkit.Chem import rdFingerprintGenerator

        self.chem = Chem
        self.morgan = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=self.bits)

    def _molecule(self, text: str, what: str):
        found = self.chem.MolFromSmiles(text) if what == "SMILES" else self.chem.MolFromSmarts(text)
        if found is None:
            raise QueryError(f"{what} does not parse: {text!r}")
        if not found.GetNumAtoms():
            raise QueryError(f"{what} has no atoms: {text!r}")
        return found

    def check_molecule(self, molecule: str) -> str:
        self._molecule(molecule, "SMILES")
        return molecule

    def check_pattern(self, pattern: str) -> str:
        """Hydrogens that can be implicit are folded into counts; others stay as written."""
        query = self._molecule(pattern, "SMARTS")
        count = lambda m: sum(a.GetAtomicNum() == 1 for a in m.GetAtoms())
        folded = self.chem.MergeQueryHs(query)
        if count(folded) == count(query):
            return pattern
        rewritten = self.chem.MolToSmarts(folded)
        warnings.warn(f"hydrogens folded: {pattern!r} became {rewritten!r}", stacklevel=2)
        return rewritten

    def canonical(self, molecule: str) -> str:
        return self.chem.MolToSmiles(self._molecule(molecule, "SMILES"))

    def pattern_bits(self, molecule: str, query: bool = False) -> list[int]:
        found = self._molecule(molecule, "SMARTS" if query else "SMILES")
        return list(self.chem.PatternFingerprint(found, fpSize=self.bits).GetOnBits())

    def similarity_bits(self, molecule: str) -> list[int]:
        return list(self.morgan.GetFingerprint(self._molecule(molecule, "SMILES")).GetOnBits())

    def identity(self, molecule: str) -> str | None:
        from rdkit.Chem import RegistrationHash as R

        found = self.chem.MolFromSmiles(molecule)
        if found is None:
            return None
        for atom in found.GetAtoms():
            atom.SetAtomMapNum(0)
        return R.GetMolHash(R.GetMolLayers(found, enable_tautomer_hash_v2=True))

    def parent(self, molecule: str) -> str | None:
        from rdkit.Chem import SaltRemover

        found = self.chem.MolFromSmiles(molecule)
        return None if found is None else self.identity(self.chem.MolToSmiles(SaltRemover.SaltRemover().StripMol(found, dontRemoveEverything=True)))

    def contains(self, molecule: str, pattern: str) -> bool:
        found = self.chem.MolFromSmiles(molecule)
        return found is not None and found.HasSubstructMatch(self.chem.MolFromSmarts(pattern))


def available() -> Chemistry:
    """The toolkit if it can be imported, else strings."""
    try:
        return ToolkitChemistry()
    except ImportError:
        return TextChemistry()
