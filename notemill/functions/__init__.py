"""Pure ``Column -> Column`` helpers; everything here stays on the JVM."""
