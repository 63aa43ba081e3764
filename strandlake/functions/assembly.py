"""Chromosome lengths of the human assembly GRCh38."""

from __future__ import annotations

# Base pairs of each chromosome, from 1 to 22, X, Y and MT.
LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259, "6": 170805979, "7": 159345973, "8": 145138636,
    "9": 138394717, "10": 133797422, "11": 135086622, "12": 133275309, "13": 114364328, "14": 107043718, "15": 101991189, "16": 90338345,
    "17": 83257441, "18": 80373285, "19": 58617616, "20": 64444167, "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415, "MT": 16569,
}


def chromosome_length(chrom: str) -> int | None:
    """Length of a chromosome, with or without the prefix chr; None where it is not one of the assembly."""
    name = chrom.removeprefix("chr")
    return LENGTHS.get("MT" if name == "M" else name)
