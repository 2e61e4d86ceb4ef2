"""Column expressions shared by the jobs. Everything stays inside the JVM."""
