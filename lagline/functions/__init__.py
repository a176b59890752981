"""Column functions, all JVM-side and safe under ANSI."""
