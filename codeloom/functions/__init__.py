"""Part of codeloom; see the package README."""
