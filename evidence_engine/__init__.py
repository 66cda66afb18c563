"""Item-bank and learning-evidence analytics as DataFrame operators."""
