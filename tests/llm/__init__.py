"""Tests of the document operators; a package, so that modules here may share a name with those above."""
