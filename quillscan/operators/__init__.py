"""The eight detectors, in the order in which findings are collected."""

from quillscan.operators import citations, consistency, images, metadata, repetition, residue, structure, style

DETECTORS = {
    "chatbot_residue": residue.detect,
    "repetition": repetition.detect,
    "style_patterns": style.detect,
    "structure": structure.detect,
    "citations": citations.detect,
    "consistency": consistency.detect,
    "images": images.detect,
    "metadata": metadata.detect,
}
